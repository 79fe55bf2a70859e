"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors are one node. Nodes are dealt to overlapping regions around
centroids. Within a region, small overlapping cluster shards each give a graph
whose adjacency lists are pruned robustly (a neighbour goes if a kept one is
much nearer to it); the lists of a node in several shards are united. A greedy
search enters at the shards' medoids and at the query's own node, walks the
flat graph best first, and widens its range for as long as it meets nodes
within the threshold. Every
link found is verified by cosine in double precision. A brute-force audit
of a bounded sample measures recall; if it falls short, the search is
repeated with more overlap and a wider range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespark.session import cut_lineage

from .common import components, drawn


def robust_prune(x: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Adjacency lists (rows of ids, -1 after the last) from each row's candidates, nearest first.

    A candidate goes once a kept neighbour is ``alpha`` times nearer to it than the row itself is.
    """
    m, c = near.shape
    dist = lambda a, b: 2 - 2 * np.einsum("...d,...d->...", a, b)  # noqa: E731  squared, on unit vectors
    to_row = np.where(near >= 0, dist(x[:, None, :], x[near]), np.inf)
    out = np.full((m, degree), -1, np.int64)
    rows = np.arange(m)
    for k in range(degree):
        best = to_row.argmin(axis=1)
        alive = np.isfinite(to_row[rows, best])
        if not alive.any():
            break
        picked = near[rows, best]
        out[alive, k] = picked[alive]
        between = dist(x[np.where(alive, picked, 0)][:, None, :], x[near])
        gone = alpha * alpha * between <= to_row
        gone[rows, best] = True
        to_row[gone & alive[:, None]] = np.inf
    return out


def centroids(x: np.ndarray, k: int, seed: int, steps: int = 6) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        home = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def build(x: np.ndarray, shard: int, overlap: int, degree: int, alpha: float, candidates: int, seed: int):
    """United adjacency lists over overlapping cluster shards, and the shards' medoids."""
    m = len(x)
    k = max(1, -(-m // shard))
    c = centroids(x, k, seed)
    sims = x @ c.T
    homes = np.argsort(-sims, axis=1)[:, :min(overlap, k)]
    lists, medoids = [], []
    rng = np.random.default_rng(seed)
    for s in range(k):
        own = np.nonzero((homes == s).any(axis=1))[0]
        if not len(own):
            continue
        medoids.append(own[sims[own, s].argmax()])
        for part in np.array_split(rng.permutation(own), -(-len(own) // (2 * shard * overlap))):
            part = np.sort(part)    # a crowded shard is built in parts
            inner = x[part] @ x[part].T
            np.fill_diagonal(inner, -np.inf)
            n = min(candidates, len(part) - 1)
            if n < 1:
                continue
            near = np.argpartition(-inner, n - 1, axis=1)[:, :n]
            medoids.append(part[0])
            kept = robust_prune(x[part], near, degree, alpha)
            lists.append((part, np.where(kept >= 0, part[kept], -1)))
    width = degree * (overlap + 1)
    src = np.concatenate([np.repeat(p, l.shape[1]) for p, l in lists] or [np.zeros(0, np.int64)])
    dst = np.concatenate([l.ravel() for _, l in lists] or [np.zeros(0, np.int64)])
    ok = dst >= 0
    edges = np.unique(np.stack([np.r_[src[ok], dst[ok]], np.r_[dst[ok], src[ok]]]), axis=1)   # both directions
    start = np.searchsorted(edges[0], np.arange(m + 1))
    width = min(width, int(np.diff(start).max(initial=0)))
    adjacency = np.full((m, max(1, width)), -1, np.int64)
    for i in range(m):
        mine = edges[1, start[i]:start[i + 1]]
        if len(mine) > width:
            mine = mine[np.argsort(-(x[mine] @ x[i]), kind="stable")[:width]]
        adjacency[i, :len(mine)] = mine
    return adjacency, np.unique(medoids)


def range_search(x, adjacency, entries, queries, threshold: float, breadth: int, block: int = 256):
    """Rows and nodes of all links found: pairs (query, node) with similarity of ``threshold`` or more."""
    m, found_q, found_n = len(x), [], []
    slack = threshold - 1e-6
    for a in range(0, len(queries), block):
        q = queries[a:a + block]
        n, rows = len(q), np.arange(len(q))
        sim = np.full((n, m + 1), -2.0)      # the last column takes the padding
        waits = np.full((n, m + 1), -2.0)    # similarity of nodes met but not yet expanded
        first = x[q] @ x[entries].T
        sim[:, entries] = first
        waits[:, entries] = first
        sim[rows, q] = 1.0
        waits[rows, q] = 1.0                 # a query that is a node starts from there as well
        best_few = np.sort(first, axis=1)[:, ::-1][:, :breadth]
        if best_few.shape[1] < breadth:
            best_few = np.pad(best_few, ((0, 0), (0, breadth - best_few.shape[1])), constant_values=-2.0)
        live = rows
        while len(live):
            at = waits[live].argmax(axis=1)
            value = waits[live, at]
            # go on within the best few, and beyond them while nodes are in range
            go = (value > -2.0) & ((value >= best_few[live, -1]) | (value >= slack))
            live, at = live[go], at[go]
            if not len(live):
                break
            waits[live, at] = -2.0
            nxt = adjacency[at]
            new = (nxt >= 0) & (sim[live[:, None], nxt] <= -2.0)
            r, c = np.nonzero(new)
            if not len(r):
                continue
            node = nxt[r, c]
            s = np.einsum("id,id->i", x[q[live[r]]], x[node])
            sim[live[r], node] = s
            waits[live[r], node] = s
            fresh = np.full((len(live), nxt.shape[1]), -2.0)
            fresh[r, c] = s
            both = np.concatenate([best_few[live], fresh], axis=1)
            best_few[live] = -np.sort(np.partition(-both, breadth - 1, axis=1)[:, :breadth], axis=1)
        sim[rows, q] = -2.0
        r, c = np.nonzero(sim[:, :m] >= threshold)
        found_q.append(q[r])
        found_n.append(c)
    return np.concatenate(found_q or [np.zeros(0, np.int64)]), np.concatenate(found_n or [np.zeros(0, np.int64)])


def _spanning(a: np.ndarray, b: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest position of its group) that connect what the links connect."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.nonzero(label != np.arange(m))[0]
    return node, label[node]


def _nodes(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows as ``(vec_id, key, ok)``, and the distinct usable vectors as ``(node, key, vec, copies)``."""
    v = F.col(vec_col).cast("array<double>")
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) \
        & F.exists(v, lambda x: x != 0)
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(fine, F.lit(False)).alias("ok"),
                        F.when(fine, F.transform(v, lambda x: x + F.lit(0.0))).alias("vec"))
    given = given.withColumn("key", F.xxhash64("vec"))
    nodes = given.where("ok").groupBy("key", "vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    return given, nodes


def _search(nodes: DataFrame, n: int, threshold: float, overlap: int, breadth: int, region_rows: int, shard: int,
            degree: int, alpha: float, sample_rows: int, seed: int) -> DataFrame:
    """Rows ``(node, links, root)`` from every region: links counted once, and edges that span them."""
    sample = nodes.where(drawn(["node"], sample_rows, n, seed)).orderBy("node").select("vec").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["vec"]), []).append(r["vec"])
    k = max(1, -(-n // region_rows))
    middles = {}
    for d, vs in by_dim.items():
        x = np.array(vs, float)
        middles[d] = centroids(x / np.linalg.norm(x, axis=1, keepdims=True), max(1, k * len(vs) // len(sample)), seed)

    def assign(frames):
        for f in frames:
            if not len(f):
                continue
            parts = []
            for d, g in f.groupby(f["vec"].map(len)):
                x = np.stack(g["vec"].to_numpy()).astype(float)
                # scaled first, so that squares neither overflow nor vanish
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                c = middles.get(d)
                if c is None:
                    home = np.zeros((len(g), 1), np.int64)
                else:
                    home = np.sort(np.argsort(-(x @ c.T), axis=1)[:, :overlap], axis=1)
                parts.append(pd.DataFrame({"node": g["node"].to_numpy(), "copies": g["copies"].to_numpy(),
                                           "vec": list(x), "homes": [[f"{d}-{h}" for h in hs] for hs in home]}))
            yield pd.concat(parts)

    placed = cut_lineage(nodes.select("node", "copies", "vec").mapInPandas(
        assign, "node long, copies long, vec array<double>, homes array<string>"))
    spread = placed.withColumn("region", F.explode("homes"))
    sizes = cut_lineage(spread.groupBy("region").agg(F.count("*").alias("n")).select(
        "region", F.ceil(F.col("n") / (2 * region_rows * overlap)).cast("int").alias("blocks")))
    # A crowded region is cut into blocks, and every pair of blocks is a task of its own.
    cut = spread.join(sizes.withColumnRenamed("region", "r"), F.col("region") == F.col("r")).withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")).cast("int"))
    tiles = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("block")) * F.col("blocks")
                    + F.greatest(o, F.col("block"))))
    dealt = cut.select("node", "copies", "vec", "homes", "region", "blocks", "block", F.explode(tiles).alias("tile"))

    def region(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node", kind="stable", ignore_index=True)
        x = np.stack(f["vec"].to_numpy())
        here, blocks, tile = f["region"][0], int(f["blocks"][0]), int(f["tile"][0])
        adjacency, entries = build(x, shard, 2, degree, alpha, 3 * degree, seed)
        q, n_ = range_search(x, adjacency, entries, np.arange(len(x)), threshold, breadth)
        a, b = np.minimum(q, n_), np.maximum(q, n_)
        pairs = np.unique(np.stack([a, b]), axis=1)     # found from either side
        a, b = pairs
        homes, block = f["homes"].tolist(), f["block"].to_numpy()
        codes = {h: c for c, h in enumerate(sorted({h for hs in homes for h in hs}))}
        width = max(map(len, homes))
        grid = np.array([[codes[h] for h in hs] + [-1] * (width - len(hs)) for hs in homes])
        # a link counts in the first region that both have, and there in the first tile that holds both
        first = np.full(len(a), len(codes))
        for i in range(width):
            same = (grid[a, i][:, None] == grid[b]).any(axis=1) & (grid[a, i] >= 0)
            first = np.where(same, np.minimum(first, grid[a, i]), first)
        mine = first == codes[here]
        if blocks > 1:
            lo, hi = np.minimum(block[a], block[b]), np.maximum(block[a], block[b])
            low, high = divmod(tile, blocks)
            mine &= np.where(lo == hi, (low == lo) & (high == lo), (low == lo) & (high == hi))
        copies = f["copies"].to_numpy()
        links = np.zeros(len(f), np.int64)
        np.add.at(links, a[mine], copies[b[mine]])
        np.add.at(links, b[mine], copies[a[mine]])
        node, root = _spanning(a, b, len(f))
        roots = np.arange(len(f))
        roots[node] = root
        ids = f["node"].to_numpy()
        return pd.DataFrame({"node": ids, "links": links, "root": ids[roots]})

    return cut_lineage(dealt.groupBy("region", "tile").applyInPandas(region, "node long, links long, root long"))


def audit(nodes: DataFrame, n: int, found: DataFrame, threshold: float, rows: int, seed: int) -> list[tuple]:
    """``(found, there are)`` links of about ``rows`` sampled nodes, those with any (brute force against all nodes)."""
    few = nodes.where(drawn(["node"], rows, n, seed + 1)).select("node", "vec").collect()
    if not few:
        return []
    by_dim: dict[int, tuple] = {}
    for d in {len(r["vec"]) for r in few}:
        x = np.array([r["vec"] for r in few if len(r["vec"]) == d], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        by_dim[d] = (np.array([r["node"] for r in few if len(r["vec"]) == d]),
                     x / np.linalg.norm(x, axis=1, keepdims=True))

    def count(frames):
        total: dict[int, int] = {}
        for f in frames:
            for d, g in f.groupby(f["vec"].map(len)) if len(f) else ():
                if d in by_dim:
                    y = np.stack(g["vec"].to_numpy()).astype(float)
                    y /= np.abs(y).max(axis=1, keepdims=True)
                    y /= np.linalg.norm(y, axis=1, keepdims=True)
                    hit = (by_dim[d][1] @ y.T >= threshold) & (by_dim[d][0][:, None] != g["node"].to_numpy())
                    for k, c in zip(by_dim[d][0].tolist(), (hit * g["copies"].to_numpy()).sum(axis=1).tolist()):
                        total[k] = total.get(k, 0) + c
        yield pd.DataFrame({"node": list(total), "n": list(total.values())}, dtype="int64")

    there = nodes.select("node", "copies", "vec").mapInPandas(count, "node long, n long") \
        .groupBy("node").agg(F.sum("n").alias("n")).where("n > 0").collect()    # sampled nodes only
    got = {r["node"]: r["n"] for r in found.where(F.col("node").isin([r["node"] for r in few]))
           .groupBy("node").agg(F.sum("links").alias("n")).collect()}
    return [(got.get(r["node"], 0), r["n"]) for r in there]


def recall(audited: list[tuple]) -> float:
    """The least of the share of all links found, the mean share of a node's, and the share of nodes with all links.

    A few nodes of very many links settle the first alone.
    """
    if not audited:
        return 1.0
    got, there = np.array(audited, float).T
    return float(min(got.sum() / there.sum(), (got / there).mean(), (got >= there).mean()))


def near_duplicates(rows: DataFrame, threshold: float = 0.95, overlap: int = 3, breadth: int = 24,
                    region_rows: int = 600, shard: int = 200, degree: int = 12, alpha: float = 1.2,
                    sample_rows: int = 4096, audit_rows: int = 256, least_recall: float = 0.99, seed: int = 17,
                    id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``rows``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of different length do not link. Copies of a
    vector link with each other. ``n_links`` counts rows. Repeated ids are
    rows of their own; a null id never names a component that has another id.
    Other columns are not read. If the audit still finds a recall below
    ``least_recall`` after the third search, an error is raised.
    """
    given, groups = _nodes(rows, id_col, vec_col)
    given = cut_lineage(given)
    groups = cut_lineage(groups.withColumn("node", F.monotonically_increasing_id()))
    n = groups.count()
    for last in (False, False, True):
        found = _search(groups, n, threshold, overlap, breadth, region_rows, shard, degree, alpha, sample_rows, seed)
        seen = recall(audit(groups, n, found, threshold, audit_rows, seed))
        if seen >= least_recall:
            break
        if last:
            raise RuntimeError(f"the audit's recall is {seen:.4f}, below {least_recall}: raise overlap or breadth")
        overlap, breadth = 2 * overlap, 2 * breadth
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.where(F.col("node") != F.col("root")).select(F.col("node").alias("src"),
                                                                         F.col("root").alias("dst")))
    named = groups.select("node", "key", "vec", "copies", "first").join(links, "node", "left") \
        .join(comp.withColumnRenamed("component", "c"), "node", "left") \
        .withColumn("c", F.coalesce("c", "node"))
    named = cut_lineage(named)
    firsts = named.groupBy("c").agg(F.min("first").alias("component_id"))
    classes = cut_lineage(named.join(firsts, "c").select(
        F.col("key").alias("k"), F.col("vec").alias("v"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    alone = given.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    linked = given.where("ok").join(classes, (F.col("key") == F.col("k")) & (F.col("vec") == F.col("v"))).select(
        "vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"),
                                                                   F.lit(True)))
