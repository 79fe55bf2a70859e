"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse: a list of terms and an integer weight for each. Candidates
are dealt to blocks of bounded size and the queries to parts; every part meets
every block in a task of its own. There the block becomes posting lists, one a
term. A query adds, term after term, its own weight times the posted weights
into a dense array with one score per candidate; no candidate is skipped. The
k best of a block are cut off by partition selection, and the blocks' bests
are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanespark.session import cut_lineage

from .common import is_empty

_FOUND = pa.schema([("query", pa.int64()), ("cand", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def postings(start: np.ndarray, terms: np.ndarray, weights: np.ndarray):
    """``{term: (positions, weights)}`` of rows ``start[i]:start[i + 1]``, weights of zero left out."""
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    live = weights != 0
    row, terms, weights = row[live], terms[live], weights[live]
    order = np.lexsort((row, terms))
    row, terms, weights = row[order], terms[order], weights[order]
    names, first = np.unique(terms, return_index=True)
    ends = np.append(first[1:], len(terms))
    return {int(t): (row[a:b], weights[a:b]) for t, a, b in zip(names, first, ends)}


def _spread(lists: dict, n: int, dtype) -> dict:
    """Posting lists of a quarter of the rows or more as arrays over all rows (zero where there is no posting)."""
    out = {}
    for term, (at, w) in lists.items():
        if 4 * len(at) >= n:
            full = np.zeros(n, dtype)
            full[at] = w
            out[term] = (None, full)
        else:
            out[term] = (at, w.astype(dtype))
    return out


def accumulate(lists: dict, n: int, start: np.ndarray, terms: np.ndarray, weights: np.ndarray, dtype=np.int64):
    """Dense scores ``[query, candidate]`` of sparse query rows: one term at a time, all its postings (``_spread``).

    The few queries of a call keep their scores in the processor's cache.
    """
    m = len(start) - 1
    scores, adds = np.zeros((m, n), dtype), np.empty((m, n), dtype)
    for term, (asking, asked) in postings(start, terms, weights).items():
        if term not in lists:
            continue
        at, held = lists[term]
        if at is None and 2 * len(asking) >= m:
            whole = np.zeros(m, dtype)
            whole[asking] = asked
            np.multiply(whole[:, None], held, out=adds)
            scores += adds
        elif at is None:
            scores[asking] += asked.astype(dtype)[:, None] * held
        else:
            scores[np.ix_(asking, at)] += asked.astype(dtype)[:, None] * held
    return scores


def select(scores: np.ndarray, k: int) -> list[np.ndarray]:
    """For every row the columns of its k greatest scores; of equal scores the first columns."""
    n = scores.shape[1]
    if n <= k:
        return [np.arange(n)] * len(scores)
    bound = np.partition(scores, n - k, axis=1)[:, n - k]
    out = []
    for row, least in zip(scores, bound):
        above = np.nonzero(row > least)[0]
        out.append(np.concatenate([above, np.nonzero(row == least)[0][:k - len(above)]]))
    return out


def _sparse(table: pa.Table):
    """Offsets, terms and weights of a table's list columns."""
    t, w = (table.column(c).combine_chunks() for c in ("terms", "weights"))
    t, w = (a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in (t, w))
    start = np.concatenate([[0], np.cumsum(t.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    flat = [a.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for a in (t, w)]
    return start, *flat


def _score_type(lists: dict, start: np.ndarray, weights: np.ndarray):
    """The narrowest type that holds every score and every sum on the way to it."""
    most = max((int(np.abs(w).max()) for _, w in lists.values()), default=0)
    bound = most * int(np.abs(weights).max()) * int(np.diff(start).max()) if len(weights) else 0
    if bound >= 1 << 62:
        raise OverflowError("a score may pass 64 bits: scale the weights down")
    return np.int32 if bound < 1 << 31 else np.int64


def _search(k: int, cache_bytes: int):
    def run(key, asked, block):
        if len(asked) and len(block):
            # candidates by id, nulls last, so that the first of equal scores has the smallest id
            block = block.sort_by([("no_id", "ascending"), ("id", "ascending"), ("row", "ascending")])
            rows, n = block["row"].to_numpy(), len(block)
            lists = postings(*_sparse(block))
            start, terms, weights = _sparse(asked)
            dtype = _score_type(lists, start, weights)
            lists, batch = _spread(lists, n, dtype), max(1, cache_bytes // (n * dtype().itemsize))
            query = asked["row"].to_numpy()
            place = {r: i for i, r in enumerate(rows.tolist())}
            picks, owners, best = [], [], []
            for a in range(0, len(query), batch):
                b = min(a + batch, len(query))
                lo, hi = start[a], start[b]
                scores = accumulate(lists, n, start[a:b + 1] - lo, terms[lo:hi], weights[lo:hi],
                                    dtype)
                own = [place.get(q, -1) for q in query[a:b].tolist()]
                for i, cols in enumerate(select(scores, k + 1)):    # one more: the query's own row goes
                    if own[i] >= 0:
                        cols = cols[cols != own[i]]
                    if len(cols) > k:
                        cols = cols[np.lexsort((cols, -scores[i, cols]))[:k]]
                    picks.append(cols)
                    owners.append(np.full(len(cols), query[a + i]))
                    best.append(scores[i, cols].astype(np.int64))
            at = np.concatenate(picks)
            return pa.table([pa.array(np.concatenate(owners)), pa.array(rows[at]), block["id"].take(pa.array(at)),
                             pa.array(np.concatenate(best))], schema=_FOUND)
        return _FOUND.empty_table()

    return run


def top_k(rows: DataFrame, is_query, k: int = 20, block_rows: int = 4096, query_rows: int = 4096,
          cache_bytes: int = 1 << 20) -> DataFrame:
    """``query_id, rank, id, score``: the k rows of greatest inner product with every query row, itself left out.

    ``rows`` has ``id`` (long), ``terms`` and ``weights`` (arrays of long of
    equal length, a term at most once a row); ``is_query`` is a condition on
    them. A term that one of two rows lacks counts as zero, so rows without
    terms score zero with all. Equal scores go by the smaller id (null ids
    last). Repeated rows are rows of their own: each is a candidate of the
    others, and each repeated query has its own k. Fewer candidates than k: all
    of them. An empty table gives no rows; other columns are not read. Scores
    that could pass 64 bits raise an error.
    """
    given = cut_lineage(rows.select("id", "terms", "weights", F.coalesce(is_query, F.lit(False)).alias("asks"))
                        .withColumn("row", F.monotonically_increasing_id()))
    n, asking = given.agg(F.count("*"), F.count_if("asks")).first()
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-asking // query_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    held = given.select("id", F.col("id").isNull().alias("no_id"), "row", "terms", "weights",
                        dealt(blocks).alias("block"), every(parts).alias("part"))
    asked = given.where("asks").select("row", "terms", "weights", dealt(parts).alias("part"),
                                       every(blocks).alias("block"))
    best = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(
        _search(k, cache_bytes), "query long, cand long, id long, score long")
    # every map task keeps k rows a query before the shuffle
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "cand")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = given.where("asks").select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def quantised(rows: DataFrame, scale: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Vectors as sparse rows ``(id, terms, weights)``: component i is term i with weight floor(scale * component).

    Vectors that are null or hold null or non-finite components are left out; zero weights have no term.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    w = F.transform(v, lambda x, i: F.struct(i.cast("long").alias("t"), F.floor(x * F.lit(float(scale))).alias("w")))
    return rows.where(F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.filter(w, lambda s: s["w"] != 0).alias("s")).select(
        "id", F.col("s.t").alias("terms"), F.col("s.w").alias("weights"))
