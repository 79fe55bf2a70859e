"""Exact nearest neighbours over cells with distance bounds (JN-09, SL-08, ML-05, ML-14).

The base rows are dealt to cells around k-means centres of two levels; the
number of cells grows with the rows, and a crowded cell is cut into blocks of
bounded size. Each query first looks into the nearest cells that hold enough
rows. Its k-th distance then rules out every cell whose centre lies farther
away than that distance plus the cell's radius (triangle inequality); the cells
that are left are searched in a second pass, so the result is exact and every
query has k neighbours (or all rows, if there are fewer). Neighbouring cells
travel as one region of about ``block_rows`` rows, to which a query goes once
however many of its cells it needs. Queries that ask for a region are dealt to
parts, and the region's blocks are copied to just those parts: a region that
nobody asks for stays where it is, another one travels once for every
``query_rows`` queries. A block is compared with its queries as matrices of
bounded size and returns only the k best for each: pairs are never emitted, and
of equal vectors only the k smallest ids are looked at. On vectors without
structure the bounds rule out little and the second pass is a blocked scan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: The upper centres are fitted on about this many rows, and so are the lower centres of each upper one.
SAMPLE_ROWS = 4096
#: Most cells; beyond, cells have more rows and are cut into blocks. The driver holds a centre and two numbers for each.
MOST_CELLS = 65_536
#: Values of a matrix, and candidate pairs whose distance is worked out, at once in a task.
MATRIX_CELLS = 1_000_000
PAIRS = 65_536


def _kmeans(x: np.ndarray, k: int, seed: int, steps: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(steps):
        home = _far2(x, c).argmin(axis=1)
        n = np.bincount(home, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _far2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, up to rounding."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0.0)


def _rounding(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far ``_far2`` may be off, for each row of ``a``."""
    return 1e-12 * ((a * a).sum(1) + (b * b).sum(1).max(initial=0.0)) * max(1, a.shape[1])


def _stack(v) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float)


class Cells:
    """Base rows in cells: centres, radii and sizes on the driver, the rows with their cell in ``placed``.

    Cells that follow each other make a region of up to ``region_rows`` rows, at least one cell.
    """

    def __init__(self, base: DataFrame, n: int, cell_rows: int, seed: int, region_rows: int = 0):
        k = max(1, min(MOST_CELLS, n // cell_rows))
        upper_k = k if k <= 256 else int(np.ceil(np.sqrt(k)))
        share = F.pmod(F.xxhash64("neighbor_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        few = base.where(share <= min(1.0, SAMPLE_ROWS / n)).select("v").collect() or base.select("v").take(1)
        upper = _kmeans(np.array([r["v"] for r in few], float), upper_k, seed)
        lower = {i: c[None] for i, c in enumerate(upper)}
        if upper_k < k:
            each = -(-k // upper_k)

            def inner(key, f):
                c = _kmeans(_stack(f["v"]), each, seed)
                return pd.DataFrame({"upper": [key[0]] * len(c), "v": list(c)})

            def near(frames):
                for f in frames:
                    if len(f):
                        yield f.assign(upper=_far2(_stack(f["v"]), upper).argmin(1).astype("int32"))

            drawn = base.where(share <= min(1.0, SAMPLE_ROWS * upper_k / n)).select("v").mapInPandas(
                near, "v array<double>, upper int")
            got: dict[int, list] = {}
            for r in drawn.groupBy("upper").applyInPandas(inner, "upper int, v array<double>").collect():  # the centres
                got.setdefault(r["upper"], []).append(r["v"])
            lower.update({i: np.array(sorted(c)) for i, c in got.items()})
        first = np.cumsum([0, *[len(lower[i]) for i in range(len(upper))]])
        self.centers = np.concatenate([lower[i] for i in range(len(upper))])

        def place(frames):
            for f in frames:
                if not len(f):
                    continue
                x = _stack(f["v"])
                top, cell = _far2(x, upper).argmin(1), np.zeros(len(f), np.int64)
                for i in np.unique(top):
                    cell[top == i] = first[i] + _far2(x[top == i], lower[i]).argmin(1)
                away = np.sqrt(((x - np.concatenate([lower[i] for i in range(len(upper))])[cell]) ** 2).sum(1))
                yield f.assign(cell=cell.astype("int32"), away=away)

        self.placed = cut_lineage(base.select("neighbor_id", "v", "grp").mapInPandas(
            place, "neighbor_id long, v array<double>, grp long, cell int, away double"))
        self.sizes, self.radius = np.zeros(len(self.centers), np.int64), np.zeros(len(self.centers))
        for r in self.placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():
            self.sizes[r["cell"]], self.radius[r["cell"]] = r["n"], r["radius"]     # one row per cell
        self.region, have = np.zeros(len(self.centers), np.int32), 0
        for i, m in enumerate(self.sizes):      # cells of one upper centre follow each other
            self.region[i] = self.region[i - 1] if i else 0
            if i and have + m > region_rows:
                self.region[i] += 1
                have = 0
            have += m
        spark, of = base.sparkSession, self.region.tolist()
        total = np.bincount(self.region, weights=self.sizes).astype(int).tolist()
        # at most MOST_CELLS rows of three numbers
        self.regions = F.broadcast(spark.createDataFrame(
            [(i, r, total[r]) for i, r in enumerate(of)], "cell int, region int, n long"))

    def ask(self, queries: DataFrame, k: int, first: bool) -> DataFrame:
        """``queries`` (query_id, v, grp, kth) with the array ``regions`` that each has to search."""
        centers, sizes, radius, region = self.centers, self.sizes, self.radius, self.region
        enough = min(2 * k + 16, int(sizes.sum()))     # some may be of the query's own group
        rows = max(1, min(1024, MATRIX_CELLS // len(centers)))

        def run(frames):
            for f in frames:
                if not len(f):
                    continue
                q, asked = _stack(f["v"]), []
                for a in range(0, len(q), rows):
                    part = q[a:a + rows]
                    d2 = _far2(part, centers)
                    d = np.sqrt(np.maximum(d2 - _rounding(part, centers)[:, None], 0.0))
                    order = np.argsort(d2, axis=1, kind="stable")
                    need = (np.cumsum(sizes[order], axis=1) < enough).sum(axis=1) + 1
                    for i, kth in enumerate(f["kth"].to_numpy()[a:a + rows]):
                        near = order[i, :need[i]]
                        here = np.unique(region[near[sizes[near] > 0]])
                        if not first:
                            bound = np.inf if pd.isna(kth) else kth * (1 + 1e-9) + 1e-9
                            here = np.setdiff1d(region[(d[i] - radius <= bound) & (sizes > 0)], here)
                        asked.append(here.astype("int32"))
                yield f.assign(regions=asked)

        return cut_lineage(queries.mapInPandas(
            run, "query_id long, v array<double>, grp long, kth double, regions array<int>"))

    def deal(self, asked: DataFrame, block_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame]:
        """Queries and base rows with the ``(region, block, part)`` where they meet."""
        asks = asked.select("query_id", "v", "grp", F.explode("regions").alias("region"))
        parts = asked.select(F.explode("regions").alias("region")).groupBy("region").agg(
            F.ceil(F.count("*") / query_rows).cast("int").alias("parts"))
        load = F.broadcast(cut_lineage(parts.join(self.regions.select("region", "n").distinct(), "region").select(
            "region", "parts", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))))     # one row per region
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        sent = asks.join(load, "region").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")) \
            .withColumn("block", upto("blocks"))
        held = self.placed.join(self.regions.drop("n"), "cell").join(load, "region").withColumn(
            "block", F.pmod(F.xxhash64("neighbor_id"), F.col("blocks")).cast("int")).withColumn("part", upto("parts"))
        return sent.select("query_id", "v", "grp", "region", "block", "part"), \
            held.select("neighbor_id", "v", "grp", "region", "block", "part")


def _first_of_equal(x: np.ndarray, ids: np.ndarray, grp: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among a query's k nearest: of equal vectors and groups those of the k smallest ids."""
    whole = np.ascontiguousarray(np.column_stack([x, grp]) + 0.0)
    _, same = np.unique(whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    rank = np.arange(len(order)) - np.searchsorted(same[order], same[order])
    return np.sort(order[rank < k])


def _search(k: int):
    def run(key, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(q) and len(b):
            x, ids, grp = _stack(b["v"]), b["neighbor_id"].to_numpy(), b["grp"].to_numpy(float)
            few = _first_of_equal(x, ids, grp, k)
            x, ids, grp = x[few], ids[few], grp[few]
            names, own, v = q["query_id"].to_numpy(), q["grp"].to_numpy(float), _stack(q["v"])
            step = max(1, MATRIX_CELLS // len(x))
            for a in range(0, len(v), step):
                part = v[a:a + step]
                d2 = _far2(part, x)
                d2[own[a:a + step, None] == grp] = np.inf
                if len(x) > k:
                    bound = np.partition(d2, k - 1, axis=1)[:, k - 1] + 2 * _rounding(part, x)
                else:
                    bound = np.full(len(part), np.inf)
                near = (d2 <= bound[:, None]) & np.isfinite(d2)
                turn = np.cumsum(near.sum(axis=1)) // PAIRS
                for t in np.unique(turn):
                    at = np.nonzero(turn == t)[0]
                    row, col = np.nonzero(near[at])
                    d = np.sqrt(((x[col] - part[at[row]]) ** 2).sum(1))
                    order = np.lexsort((ids[col], d, row))
                    row, col, d = row[order], col[order], d[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    best = rank < k
                    out.append((names[a + at[row[best]]], ids[col[best]], d[best]))
        return pd.DataFrame({c: np.concatenate(p) for c, p in zip(("query_id", "neighbor_id", "distance"), zip(*out))})

    return run


def nearest(queries: DataFrame, base: DataFrame, k: int, cell_rows: int = 1024, block_rows: int = 16_384,
            query_rows: int = 16_384, seed: int = 42) -> DataFrame:
    """JN-09 + SL-08: (query_id, neighbor_id, distance, rank), the exact k nearest base rows of every query.

    ``queries`` has ``query_id``, ``v`` (array of double) and ``grp``, ``base``
    has ``neighbor_id``, ``v`` and ``grp``: rows of an equal non-null group are
    not each other's neighbours (NULL excludes nothing). Distances are
    Euclidean in double; ties go by neighbour id.
    """
    n = base.count()
    if n == 0 or not queries.take(1):
        return base.sparkSession.createDataFrame([], "query_id long, neighbor_id long, distance double, rank int")
    cells = Cells(base, n, cell_rows, seed, block_rows)

    def look(asked: DataFrame) -> DataFrame:
        sent, held = cells.deal(asked, block_rows, query_rows)
        keys = ["region", "block", "part"]
        return sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(
            _search(k), "query_id long, neighbor_id long, distance double")

    mine = queries.select("query_id", "v", "grp")
    one = cut_lineage(top_k(look(cells.ask(mine.withColumn("kth", F.lit(None).cast("double")), k, True)), k))
    kth = one.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("kth"))
    again = cells.ask(mine.join(kth, "query_id", "left"), k, False)
    return top_k(one.drop("rank").unionByName(look(again)), k)


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """SL-08: the k closest candidates of every query row (distance, then id, break ties).

    Each block already returned its k best, so a query's candidates are a few rows per block.
    """
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_predict(neigh: DataFrame, labels: DataFrame, id_b: str, label: str, weights: str = "uniform") -> DataFrame:
    """ML-05: mean label of the neighbours (uniform) or 1/d weighted; d = 0 neighbours take all weight."""
    j = neigh.join(labels.select(F.col(id_b).alias("neighbor_id"), F.col(label).alias("_y")), "neighbor_id")
    if weights == "uniform":
        return j.groupBy("query_id").agg(F.avg("_y").alias("prediction"), F.count(F.lit(1)).alias("n_neighbors"))
    zero = F.col("distance") == 0
    g = j.groupBy("query_id").agg(
        F.count_if(zero).alias("_nz"), F.avg(F.when(zero, F.col("_y"))).alias("_zmean"),
        F.sum(F.try_divide(F.col("_y"), F.col("distance"))).alias("_num"),
        F.sum(F.try_divide(F.lit(1.0), F.col("distance"))).alias("_den"),
        F.count(F.lit(1)).alias("n_neighbors"))
    return g.select("query_id", F.when(F.col("_nz") > 0, F.col("_zmean"))
                    .otherwise(F.col("_num") / F.col("_den")).alias("prediction"), "n_neighbors")


def elbow_curve(neigh: DataFrame, labels: DataFrame, max_k: int = 30) -> DataFrame:
    """ML-14: cross-validated R2 for every k = 1..max_k from ONE ranking, and the best k.

    ``neigh`` ranks every row's neighbours outside its own fold; ``labels`` has
    ``id``, ``fold`` and ``label``. R2 is the mean of the folds' R2; the first
    k with the greatest mean is best.
    """
    base = labels.select(F.col("id").alias("neighbor_id"), F.col("label").alias("_y"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = neigh.where(F.col("rank") <= max_k).join(base, "neighbor_id") \
        .select("query_id", F.col("rank").alias("k"), F.avg("_y").over(w).alias("prediction"))
    t = run.join(labels.select(F.col("id").alias("query_id"), "fold", F.col("label").alias("actual")), "query_id")
    err = F.col("actual") - F.col("prediction")
    per = t.groupBy("k", "fold").agg(F.sum(err * err).alias("_sse"),
                                     (F.var_pop("actual") * F.count(F.lit(1))).alias("_sst"))
    g = per.groupBy("k").agg(F.avg(F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("cv_r2"))
    best = Window.orderBy(F.desc("cv_r2"), "k")  # max_k rows
    return g.withColumn("is_best", F.row_number().over(best) == 1)


def _ship_by_value() -> None:
    """Python workers may not have this package: send the functions above by value."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
