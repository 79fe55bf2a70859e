"""Regression trees, forests and boosting of full size (ML-06..10, ML-13, FP-09).

Two phases. While a node's rows are more than a task may hold (``task_cells``
values), all trees' such nodes are split together, level by level, from
(node, feature, bin) histograms that are summed over the cluster. Once a node
fits, its rows are dealt to one task, which grows the subtree down to its
leaves: exact splits for best-split trees, one uniform threshold a node and
feature for extremely randomised ones. A task's arrays hold several nodes at
once (all of a level), so growing is a few array operations a level.

Rows that are only to be predicted travel with the rows that train and come
back with the sums of their leaves' values; trees are kept only on request.
A row's bootstrap weight, a node's random thresholds and its random features
are hashes of the row, the tree and the node's path: a task that runs again
grows the same trees.

Features are compared in single precision. Of equal gains the first feature
and the lowest threshold win.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Values of the rows that a task may hold while it grows a tree (512k rows of 8 features, 64k of 61).
TASK_CELLS = 4_000_000
#: As many distinct thresholds has a feature in the first phase and in boosting.
BINS = 255
#: Nodes whose histograms one job of the first phase sums.
NODES_A_JOB = 256
#: Values closer than this are one value.
SAME = np.float32(1e-7)

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def root_key(seed: int, tree: int) -> np.uint64:
    with np.errstate(over="ignore"):
        return _mix(np.array([seed], np.uint64) * _M1 + np.array([tree + 1], np.uint64) * _M3)[0]


def child_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the nodes' left and right children."""
    with np.errstate(over="ignore"):
        return _mix(keys + _M1), _mix(keys + _M2)


def bootstrap_weights(row_id: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1, by a hash of the row and the tree."""
    with np.errstate(over="ignore"):
        u = _uniform(_mix(row_id.astype(np.int64).view(np.uint64) * _M1 + root_key(seed, tree)))
    times = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 19)])))
    return np.searchsorted(times, u, side="right").astype(np.float64)


@dataclass(frozen=True)
class Forest:
    """What to grow. ``random``: one uniform threshold a node and feature instead of the best one.

    ``fold``: rows of this fold do not train, and only they are predicted; None: all training rows train, all rows
    are predicted. ``depths``: squared errors of the trees cut at these depths are summed as well. ``prefixes``: the
    first so many trees are a forest of their own (scores of kind ``score@n``).
    """

    name: str
    trees: int = 1
    max_depth: int | None = None
    min_leaf: int = 1
    bootstrap: bool = False
    random: bool = False
    max_features: int | None = None
    seed: int = 42
    fold: int | None = None
    depths: tuple = ()
    prefixes: tuple = ()


@dataclass
class Tree:
    """Nodes as arrays, the root first; ``feature`` is -1 at a leaf. ``gain`` is the fall of the squared error."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def walk(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Node of every column of ``x`` (features by rows), at most ``depth`` levels down."""
        at = np.zeros(x.shape[1], np.int64)
        live, step = np.nonzero(self.feature[at] >= 0)[0], 0
        while len(live) and (depth is None or step < depth):
            node = at[live]
            goes = x[self.feature[node], live] <= self.threshold[node]
            at[live] = np.where(goes, self.left[node], self.right[node])
            live, step = live[self.feature[at[live]] >= 0], step + 1
        return at


def _chosen(keys: np.ndarray, p: int, spec: Forest) -> np.ndarray | None:
    """Mask (features, nodes) of each node's drawn features, None for all."""
    if spec.max_features is None or spec.max_features >= p:
        return None
    with np.errstate(over="ignore"):
        u = _mix(keys[None, :] ^ (np.arange(1, p + 1, dtype=np.uint64)[:, None] * _M2))
    rank = u.argsort(axis=0).argsort(axis=0)
    return rank < spec.max_features


def _thresholds(low: np.ndarray, high: np.ndarray, keys: np.ndarray, first: int) -> np.ndarray:
    """Uniform thresholds (features, nodes) between the nodes' least and greatest values."""
    with np.errstate(over="ignore"):
        f = np.arange(first + 1, first + 1 + len(low), dtype=np.uint64)[:, None]
        u = _uniform(_mix(keys[None, :] + f * _M3))
    t = low.astype(np.float64) + u * (high.astype(np.float64) - low.astype(np.float64))
    return np.where(t >= high, low, t)


def _best_splits(rows, values, wy, w, start, size, s, weight, keys, spec):
    """Feature, threshold and gain of every node's best split (feature -1: none).

    ``rows`` and ``values`` have a row for each feature: the nodes' row numbers
    and values in the feature's order, node after node.
    """
    p, m = rows.shape
    k = len(start)
    mask = _chosen(keys, p, spec)
    best, found = np.full(k, -np.inf), np.full(k, -1)
    node = np.repeat(np.arange(k), size)
    place = np.arange(m) - start[node]
    # a cut after this place leaves min_leaf rows on both sides
    inner = (place + 1 >= spec.min_leaf) & (size[node] - place - 1 >= max(1, spec.min_leaf))
    mean, whole, later = (s / weight)[node], weight[node], start[1:]

    def scores(r, v):
        """Fall of the squared error for a cut after each place."""
        r = r.astype(np.intp)
        wl, sl = w.take(r, mode="clip"), wy.take(r, mode="clip")
        wl[..., later] -= weight[:-1]       # the sums start anew at each node
        sl[..., later] -= s[:-1]
        np.cumsum(wl, axis=-1, out=wl)
        np.cumsum(sl, axis=-1, out=sl)
        other = mean * wl
        sl -= other
        sl *= sl
        np.subtract(whole, wl, out=other)
        other *= wl
        with np.errstate(divide="ignore", invalid="ignore"):
            sl /= other
        sl *= whole
        ok = np.empty(v.shape, bool)
        np.greater(v[..., 1:], v[..., :-1] + SAME, out=ok[..., :-1])
        ok[..., -1] = False
        ok &= inner
        sl[~ok] = -np.inf
        return sl

    step = max(1, 16_384 // m)                     # so many features at a time that arrays stay in cache
    for a in range(0, p, step):
        top = np.maximum.reduceat(scores(rows[a:a + step], values[a:a + step]), start, axis=1)
        if mask is not None:
            top = np.where(mask[a:a + step], top, -np.inf)
        f = (top >= top.max(axis=0) * (1 - 1e-10)).argmax(axis=0)      # gains that differ by rounding are equal
        value = top[f, np.arange(k)]
        better = (value > np.where(best > 0, best * (1 + 1e-10), best)) & (value > -np.inf)
        best[better], found[better] = value[better], a + f[better]
    own = np.maximum(found, 0)[node]
    r, v = rows[own, np.arange(m)], values[own, np.arange(m)]
    sc = scores(r, v)
    top = np.maximum.reduceat(sc, start)
    at = np.minimum.reduceat(np.where(sc >= (top * (1 - 1e-10))[node], np.arange(m), m), start)
    ok = (found >= 0) & np.isfinite(top) & (at + 1 < m)
    at = np.where(ok, at, 0)
    lower, upper = v[at].astype(np.float64), v[np.minimum(at + 1, m - 1)].astype(np.float64)
    middle = lower / 2 + upper / 2
    middle = np.where(middle >= upper, lower, middle)
    return np.where(ok, found, -1), middle, np.where(ok, top, 0.0)


def _node_sums(v: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of every node's stretch of the last axis; by running sums where nodes are small."""
    if v.shape[-1] > 16 * len(start):
        return np.add.reduceat(v, start, axis=-1)
    run = np.cumsum(v, axis=-1)
    ends = run[..., start + size - 1]
    ends[..., 1:] -= run[..., start[1:] - 1]
    return ends


def _random_splits(x, rows, wy, w, start, size, s, weight, keys, spec):
    """As ``_best_splits`` with one uniform threshold a node and feature; ``rows`` are grouped by node."""
    p, m, k = len(x), len(rows), len(start)
    mask = _chosen(keys, p, spec)
    best, found, cut = np.full(k, -np.inf), np.full(k, -1), np.zeros(k)
    wr, yr, node = w[rows], wy[rows], np.repeat(np.arange(k), size)
    plain = bool((wr == 1).all())
    step = max(1, 16_384 // m)
    for a in range(0, p, step):
        v = x[a:a + step].take(rows, axis=1)
        low, high = np.minimum.reduceat(v, start, axis=1), np.maximum.reduceat(v, start, axis=1)
        t = _thresholds(low, high, keys, a)
        goes = (v <= t.take(node, axis=1)).astype(np.float64)
        n_left = _node_sums(goes, start, size)
        wl = n_left if plain else _node_sums(goes * wr, start, size)
        goes *= yr
        sl = _node_sums(goes, start, size)
        with np.errstate(divide="ignore", invalid="ignore"):
            sc = (sl - s / weight * wl) ** 2 / (wl * (weight - wl)) * weight
        sc = np.where((high > low + SAME) & (n_left >= max(1, spec.min_leaf))
                      & (size - n_left >= max(1, spec.min_leaf)), sc, -np.inf)
        if mask is not None:
            sc = np.where(mask[a:a + step], sc, -np.inf)
        f = (sc >= sc.max(axis=0) * (1 - 1e-10)).argmax(axis=0)
        value = sc[f, np.arange(k)]
        better = (value > np.where(best > 0, best * (1 + 1e-10), best)) & np.isfinite(value)
        best[better], found[better], cut[better] = value[better], a + f[better], t[f, np.arange(k)][better]
    return found, cut, np.where(found >= 0, best, 0.0)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, order: np.ndarray | None, key, depth: int, spec: Forest) -> Tree:
    """One tree below a node at ``depth`` with ``key``; ``x`` is features by rows, ``order`` each feature's rows in
    order (not needed for random thresholds). Rows of weight 0 take no part."""
    bag, p = w > 0, len(x)
    if spec.random:
        rows, values = np.nonzero(bag)[0], None
    else:
        # row numbers in few bytes: growing is bound by the memory they pass through
        rows = order[bag[order]].reshape(p, -1).astype(np.uint16 if len(y) < 1 << 16 else np.int32)
        values = np.take_along_axis(x, rows.astype(np.intp), axis=1)
    m = rows.shape[-1]
    out: dict[str, list] = {c: [] for c in ("feature", "threshold", "left", "right", "value", "gain")}
    if not m:
        return Tree(np.array([-1]), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1), np.zeros(1))
    middle = float((w * y).sum() / w.sum())
    yc = y - middle
    wy, wyy = w * yc, w * yc * yc
    start, size, keys, made = np.zeros(1, np.int64), np.array([m]), np.array([key], np.uint64), 1

    def keep(mask):
        nonlocal rows, values
        at = np.flatnonzero(mask)
        if not spec.random:
            values = values.take(at, axis=1)
        rows = rows.take(at, axis=-1)

    while True:
        one = rows if spec.random else rows[0]
        s, weight, sq = (np.add.reduceat(v[one], start) for v in (wy, w, wyy))
        k = len(start)
        impure = sq - s * s / weight > 1e-12 * np.maximum(sq, 1e-300) + 1e-9 * weight * np.finfo(float).eps
        may = (size >= max(2, 2 * spec.min_leaf)) & impure
        if spec.max_depth is not None and depth >= spec.max_depth:
            may[:] = False
        feature, threshold, gain = np.full(k, -1), np.zeros(k), np.zeros(k)
        if may.any():
            if not may.all():
                keep(np.repeat(may, size))
            start_m = np.concatenate([[0], np.cumsum(size[may])[:-1]])
            found = _random_splits(x, rows, wy, w, start_m, size[may], s[may], weight[may], keys[may], spec) \
                if spec.random else _best_splits(rows, values, wy, w, start_m, size[may], s[may], weight[may],
                                                 keys[may], spec)
            feature[may], threshold[may], gain[may] = found
        split = feature >= 0
        n_split = int(split.sum())
        left, right = np.zeros(k, np.int64), np.zeros(k, np.int64)
        left[split], right[split] = made + np.arange(n_split), made + n_split + np.arange(n_split)
        made += 2 * n_split
        for c, v in (("feature", feature), ("threshold", threshold), ("left", left), ("right", right),
                     ("value", s / weight + middle), ("gain", np.maximum(gain, 0.0))):
            out[c].append(v)
        if not n_split:
            return Tree(**{c: np.concatenate(v) for c, v in out.items()})
        stays = np.repeat(split[may], size[may])
        if not stays.all():
            keep(stays)
        sizes = size[split]
        one = rows if spec.random else rows[0]
        node = np.repeat(np.nonzero(split)[0], sizes)
        goes = np.zeros(len(y), bool)
        goes[one] = x[feature[node], one] <= threshold[node]
        n_left = np.add.reduceat(goes[one].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        # all left children first, then all right ones; rows keep their order
        if spec.random:
            mine = goes[rows]
            rows = np.concatenate([rows[mine], rows[~mine]])
        else:
            m, cut = rows.shape[1], int(n_left.sum())
            new_rows, new_values = np.empty_like(rows), np.empty_like(values)
            step = max(1, 16_384 // m)
            for f in range(0, p, step):
                r, v = rows[f:f + step], values[f:f + step]
                mine = goes.take(r.astype(np.intp), mode="clip")
                for part, to in ((np.flatnonzero(mine), np.s_[f:f + step, :cut]), (np.flatnonzero(~mine), np.s_[f:f + step, cut:])):
                    new_rows[to] = r.take(part).reshape(len(r), -1)
                    new_values[to] = v.take(part).reshape(len(r), -1)
            rows, values = new_rows, new_values
        size = np.concatenate([n_left, sizes - n_left])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        a, b = child_keys(keys[split])
        keys, depth = np.concatenate([a, b]), depth + 1


# ---- rows ----------------------------------------------------------------------------------------------------
_ROW = [("row_id", pa.int64()), ("fold", pa.int32()), ("label", pa.float64()), ("x", pa.binary())]
_SUMS = pa.schema([("spec", pa.int32()), ("kind", pa.string()), ("id", pa.int64()), ("value", pa.float64())])
SUMS = "spec int, kind string, id long, value double"


def matrix(rows: DataFrame, x: str = "x") -> DataFrame:
    """``row_id, fold, label, x`` with the features as one binary of single-precision numbers.

    ``rows`` has ``row_id``, ``fold`` (0: does not train), ``label`` and an array column of features.
    """

    def run(batches):
        for b in batches:
            lists = b.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            cells = [flat[e - n:e].tobytes() for e, n in zip(ends, np.diff(np.concatenate([[0], ends])))]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(3)], pa.array(cells, pa.binary())],
                                             names=[n for n, _ in _ROW])

    return rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("fold").cast("int").alias("fold"),
                       F.col("label").cast("double").alias("label"), F.col(x).cast("array<double>").alias("x")) \
        .mapInArrow(run, "row_id long, fold int, label double, x binary")


def _arrays(table):
    """row_id, fold, label and x (features by rows) of a table or batch of matrix rows."""
    row_id, fold, label = (np.asarray(table.column(c)) for c in ("row_id", "fold", "label"))
    cells = table.column("x").to_pylist()
    x = np.frombuffer(b"".join(cells), "<f4").reshape(len(cells), -1).T if cells else np.zeros((0, 0), np.float32)
    return row_id, fold, label, np.ascontiguousarray(x)


def _trains(fold: np.ndarray, spec) -> np.ndarray:
    return (fold > 0) if spec.fold is None else (fold > 0) & (fold != spec.fold)


def _asked(fold: np.ndarray, spec) -> np.ndarray:
    return np.ones(len(fold), bool) if spec.fold is None else fold == spec.fold


# ---- phase one: nodes too large for a task ---------------------------------------------------------------------
def edges_of(rows: DataFrame, p: int, bins: int = BINS) -> np.ndarray:
    """Up to ``bins`` thresholds a feature (features by thresholds, padded with infinity): its values at even ranks.

    Values of at most ``bins`` distinct ones are all thresholds.
    """

    def unfold(batches):
        for b in batches:
            _, fold, _, x = _arrays(b)
            yield pa.RecordBatch.from_arrays([pa.array(list(x[:, fold > 0].T.astype(float)), pa.list_(pa.float64()))],
                                             names=["v"])

    shares = [(i + 1) / (bins + 1) for i in range(bins)]
    # a group for each feature, so that the features' summaries are made by several tasks
    long = rows.mapInArrow(unfold, "v array<double>").select(F.posexplode("v").alias("feature", "v"))
    out = np.full((p, bins), np.inf, np.float32)
    for r in long.groupBy("feature").agg(F.percentile_approx("v", shares, 10_000).alias("at")).collect():  # p rows
        values = np.unique(np.array(r["at"] or [], np.float32))
        out[r["feature"], :len(values)] = values
    return out


def codes_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of every value: how many of the feature's thresholds are below it."""
    return np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, x)]).astype(np.uint8)


def bin_starts(edges: np.ndarray) -> np.ndarray:
    """Where each feature's bins begin in a node's histogram (and, last, how many there are)."""
    return np.concatenate([[0], np.cumsum(np.isfinite(edges).sum(axis=1) + 1)])


def split_histograms(count, total, starts, min_leaf: int, mask=None):
    """Best split of nodes from (node, bin) histograms: feature (-1: none), bin, gain, left sum and count."""
    k, nodes, first = len(count), np.arange(len(count)), starts[1:-1]
    n = count[:, :starts[1]].sum(axis=1)[:, None]
    s = total[:, :starts[1]].sum(axis=1)[:, None]
    cl, sl = count.copy(), total.copy()
    cl[:, first] -= n           # the sums start anew at each feature
    sl[:, first] -= s
    np.cumsum(cl, axis=1, out=cl)
    np.cumsum(sl, axis=1, out=sl)
    cl = np.rint(cl)
    cr = n - cl
    ok = (cl >= max(1, min_leaf)) & (cr >= max(1, min_leaf))
    if mask is not None:
        ok &= np.repeat(mask, np.diff(starts), axis=0).T
    sc = sl - (s / np.maximum(n, 1e-300)) * cl
    sc *= sc
    cr *= cl
    with np.errstate(divide="ignore", invalid="ignore"):
        sc /= cr
    sc *= n
    np.copyto(sc, -np.inf, where=~ok)
    at = (sc >= sc.max(axis=1, keepdims=True) * (1 - 1e-10)).argmax(axis=1)
    top = sc[nodes, at]
    f = np.searchsorted(starts, at, side="right") - 1
    return np.where(np.isfinite(top), f, -1), at - starts[f], top, sl[nodes, at], cl[nodes, at]


class _Top:
    """The upper nodes of one tree, held by the driver: about two for every ``task_cells`` values of its rows."""

    def __init__(self, key, depth=0):
        self.key, self.depth, self.split = np.uint64(key), depth, None     # split: feature, threshold, left, right
        self.value, self.gain, self.open, self.slot, self.above = 0.0, 0.0, True, -1, ()

    def leaves(self):
        return [self] if self.split is None else self.split[2].leaves() + self.split[3].leaves()

    def inner(self):
        return [] if self.split is None else [self, *self.split[2].inner(), *self.split[3].inner()]

    def place(self, x, rows=None):
        """``(leaf, rows)`` of the columns of ``x``."""
        rows = np.arange(x.shape[1]) if rows is None else rows
        if self.split is None:
            yield self, rows
        else:
            f, t, left, right = self.split
            goes = x[f, rows] <= t
            yield from left.place(x, rows[goes])
            yield from right.place(x, rows[~goes])


def _tops(rows: DataFrame, specs: list[Forest], n_train: dict, p: int, task_cells: int, edges=None) -> dict:
    """``{(spec, tree): top}``; every leaf of a top is closed or holds few enough rows."""
    tops = {(i, t): _Top(root_key(s.seed, t)) for i, s in enumerate(specs) for t in range(s.trees)}
    large = {i for i, s in enumerate(specs) if n_train[i] * p > task_cells}
    if not large:
        return tops
    edges = edges_of(rows, p) if edges is None else edges()
    waiting = [(i, t, top) for (i, t), top in tops.items() if i in large]
    while waiting:
        jobs, waiting = [waiting[a:a + NODES_A_JOB] for a in range(0, len(waiting), NODES_A_JOB)], []
        for job in jobs:
            waiting += _split_job(rows, specs, tops, job, edges, p, task_cells)
    return tops


def _sum_arrays(parts: DataFrame) -> DataFrame:
    """Adds the ``(node, add, low, high)`` arrays of all tasks: sums, minima and maxima."""

    def add(table):
        def cells(c):
            v = table[c].to_pylist()
            return np.stack([np.frombuffer(b, np.float64) for b in v])
        return pa.table({"node": table["node"][:1], "add": [cells("add").sum(axis=0).tobytes()],
                         "low": [cells("low").min(axis=0).tobytes()], "high": [cells("high").max(axis=0).tobytes()]})

    schema = "node int, add binary, low binary, high binary"
    fan = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    once = fan.groupBy("node", "part").applyInArrow(lambda t: add(t.drop_columns(["part"])), schema)
    return once.groupBy("node").applyInArrow(add, schema)


def _split_job(rows, specs, tops, job, edges, p, task_cells):
    """Splits the nodes of a job; returns those of their children that are still too large."""
    index = {id(top): k for k, (_, _, top) in enumerate(job)}
    trees = sorted({(i, t) for i, t, _ in job})
    numbered = {}
    for i, t in trees:
        for leaf in tops[i, t].leaves():
            leaf.slot = index.get(id(leaf), -1)
        numbered[i, t] = tops[i, t]
    nodes = [(i, top.key) for i, _, top in job]
    starts = bin_starts(edges)
    cells = int(starts[-1])

    def gather(mode, cuts):
        def run(batches):
            width = {"best": 2 * cells, "range": 0, "random": 3 * p}[mode]
            add = np.zeros((len(nodes), width + 4))       # and rows, sum of squares, weight, sum
            low, high = np.full((len(nodes), p), np.inf), np.full((len(nodes), p), -np.inf)
            for b in batches:
                row_id, fold, label, x = _arrays(b)
                if not len(row_id):
                    continue
                codes = codes_of(x, edges) + starts[:-1, None] if mode == "best" else None
                for (i, t), top in numbered.items():
                    spec = specs[i]
                    if spec.random != (mode != "best"):
                        continue
                    w = _trains(fold, spec).astype(float)
                    if spec.bootstrap:
                        w *= bootstrap_weights(row_id, spec.seed, t)
                    use = np.nonzero(w)[0]
                    for leaf, at in top.place(x[:, use]):
                        if leaf.slot < 0 or not len(at):
                            continue
                        at = use[at]
                        k, wk, yk = leaf.slot, w[at], w[at] * label[at]
                        if mode == "range":
                            low[k] = np.minimum(low[k], x[:, at].min(axis=1))
                            high[k] = np.maximum(high[k], x[:, at].max(axis=1))
                            continue
                        add[k, -4:] += len(at), (yk * label[at]).sum(), wk.sum(), yk.sum()
                        if mode == "best":
                            flat = codes[:, at].ravel()
                            add[k, :cells] += np.bincount(flat, np.tile(wk, p), cells)
                            add[k, cells:2 * cells] += np.bincount(flat, np.tile(yk, p), cells)
                        else:
                            goes = x[:, at] <= cuts[:, k][:, None]
                            add[k, :p] += goes @ wk
                            add[k, p:2 * p] += goes @ yk
                            add[k, 2 * p:3 * p] += goes.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(nodes), dtype=np.int32)), *[pa.array([r.tobytes() for r in a], pa.binary())
                                                                   for a in (add, low, high)]],
                names=["node", "add", "low", "high"])

        got = _sum_arrays(rows.mapInArrow(run, "node int, add binary, low binary, high binary")).collect()
        got.sort(key=lambda r: r["node"])       # one row a node of the job
        return [np.stack([np.frombuffer(bytes(r[c]), np.float64) for r in got]) for c in ("add", "low", "high")]

    kinds = np.array([specs[i].random for i, _, _ in job])
    feature, cut, gain = np.full(len(job), -1), np.zeros(len(job)), np.zeros(len(job))
    value, left_n, size = np.zeros(len(job)), np.zeros(len(job)), np.zeros(len(job))
    left_value, right_value, error = np.zeros(len(job)), np.zeros(len(job)), np.zeros(len(job))
    keys = np.array([key for _, key in nodes], np.uint64)
    if (~kinds).any():
        add, _, _ = gather("best", None)
        count, total = add[:, :cells], add[:, cells:2 * cells]
        for k in np.nonzero(~kinds)[0]:
            spec = specs[job[k][0]]
            mask = _chosen(keys[k:k + 1], p, spec)
            f, c, top, sl, wl = (v[0] for v in split_histograms(count[k:k + 1], total[k:k + 1], starts, spec.min_leaf, mask))
            w, s = add[k, -2:]
            # a row counts as often as it was drawn, so sizes of children are told by weight
            feature[k], value[k], size[k], error[k] = f, s / w, w, add[k, -3] - s * s / w
            if f >= 0:
                cut[k], gain[k], left_n[k] = edges[f, min(c, BINS - 1)], top, wl
                left_value[k], right_value[k] = sl / wl, (s - sl) / (w - wl)
    if kinds.any():
        _, low, high = gather("range", None)
        low, high = (np.where(np.isfinite(v), v, 0.0) for v in (low, high))
        cuts = np.stack([_thresholds(low[k][:, None].astype(np.float32), high[k][:, None].astype(np.float32),
                                     keys[k:k + 1], 0)[:, 0] for k in range(len(job))], axis=1)
        add, _, _ = gather("random", cuts)
        for k in np.nonzero(kinds)[0]:
            spec = specs[job[k][0]]
            wl, sl, nl = add[k, :p], add[k, p:2 * p], add[k, 2 * p:3 * p]
            n, sq, w, s = add[k, -4:]
            ok = (high[k] > low[k] + SAME) & (nl >= spec.min_leaf) & (n - nl >= spec.min_leaf)
            mask = _chosen(keys[k:k + 1], p, spec)
            if mask is not None:
                ok &= mask[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                sc = np.where(ok, (sl - s / w * wl) ** 2 / (wl * (w - wl)) * w, -np.inf)
            f = int((sc >= sc.max() * (1 - 1e-10)).argmax())
            value[k], size[k], error[k] = s / w, w, sq - s * s / w
            if np.isfinite(sc[f]):
                feature[k], cut[k], gain[k], left_n[k] = f, cuts[f, k], sc[f], wl[f]
                left_value[k], right_value[k] = sl[f] / wl[f], (s - sl[f]) / (w - wl[f])
    again = []
    for k, (i, t, top) in enumerate(job):
        spec = specs[i]
        top.value, top.gain, top.open = float(value[k]), max(0.0, float(gain[k])), False
        end = spec.max_depth is not None and top.depth >= spec.max_depth
        if feature[k] < 0 or end or error[k] <= 1e-12 * abs(size[k] * value[k] ** 2):
            top.gain = 0.0
            continue
        a, b = child_keys(np.array([top.key], np.uint64))
        left, right = _Top(a[0], top.depth + 1), _Top(b[0], top.depth + 1)
        left.value, right.value = float(left_value[k]), float(right_value[k])
        left.above = right.above = (*top.above, top.value)
        top.split = (int(feature[k]), float(cut[k]), left, right)
        for child, n in ((left, left_n[k]), (right, size[k] - left_n[k])):
            if n * p > task_cells:
                again.append((i, t, child))
    return again


# ---- phase two: the rest of a tree in a task -------------------------------------------------------------------
def _slots(specs: list[Forest], tops: dict, tasks: int) -> list[tuple]:
    """``(spec, trees, node)``: what the tasks grow. Trees without upper nodes are grown several to a task, evenly."""
    out = []
    whole = sum(1 for top in tops.values() if top.split is None and top.open)
    share = max(1, -(-whole // max(1, tasks)))
    for i, spec in enumerate(specs):
        plain = [t for t in range(spec.trees) if tops[i, t].split is None and tops[i, t].open]
        for part in np.array_split(plain, -(-len(plain) // share)) if plain else []:
            out.append((i, part.tolist(), None))
        for t in range(spec.trees):
            if t not in plain:
                for leaf in tops[i, t].leaves():
                    leaf.slot = len(out)
                    out.append((i, [t], leaf))
    return out


def _deal(specs, tops, slots):
    """Task: every row to the slots it trains or is predicted in."""
    plain = [(s, i) for s, (i, _, leaf) in enumerate(slots) if leaf is None]
    upper = {(i, t) for i, ts, leaf in slots if leaf is not None for t in ts}

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            _, fold, _, x = _arrays(b)

            def sent(slot, at):
                part = b.take(pa.array(at))
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), slot, np.int32)), *part.columns],
                                                  names=["slot", *[n for n, _ in _ROW]])

            for slot, i in plain:
                at = np.nonzero(_trains(fold, specs[i]) | _asked(fold, specs[i]))[0]
                if len(at):
                    yield sent(slot, at)
            for i, t in sorted(upper):
                use = np.nonzero(_trains(fold, specs[i]) | _asked(fold, specs[i]))[0]
                for leaf, at in tops[i, t].place(x[:, use]):
                    if len(at):
                        yield sent(leaf.slot, use[at])

    return run


def _slot_trees(table, specs, slots):
    """Slot number, spec and node, the slot's rows, and its trees with their numbers."""
    slot = table["slot"][0].as_py()
    i, numbers, leaf = slots[slot]
    spec = specs[i]
    row_id, fold, label, x = _arrays(table.sort_by("row_id"))
    train = _trains(fold, spec)
    tx, ty, ids = x[:, train], label[train], row_id[train]
    order = None if spec.random else np.argsort(tx, axis=1, kind="stable").astype(np.int32)

    def grown():
        for t in numbers:
            w = bootstrap_weights(ids, spec.seed, t) if spec.bootstrap else np.ones(len(ids))
            if leaf is not None and (not leaf.open or not (w > 0).any()):     # a leaf of the upper nodes
                yield t, Tree(np.array([-1]), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64),
                              np.array([leaf.value]), np.zeros(1))
            else:
                yield t, grow(tx, ty, w, order, root_key(spec.seed, t) if leaf is None else leaf.key,
                              0 if leaf is None else leaf.depth, spec)

    return slot, i, spec, leaf, (row_id, fold, label, x), (tx, ty), grown()


def _slot_sums(specs, slots):
    """Task: grows a slot's trees and sums what they say of its rows."""

    def run(table):
        slot, i, spec, leaf, (row_id, fold, label, x), (tx, ty), trees = _slot_trees(table, specs, slots)
        asked = np.nonzero(_asked(fold, spec))[0]
        ax, ay = x[:, asked], label[asked]
        sizes = (*sorted(spec.prefixes), spec.trees)
        sums, gains = np.zeros((len(sizes), len(asked))), np.zeros(len(x))
        errors = {d: [0.0, 0.0] for d in spec.depths}
        above = () if leaf is None else leaf.above
        for t, tree in trees:
            sums[[k for k, n in enumerate(sizes) if t < n]] += tree.value[tree.walk(ax)]
            inner = tree.feature >= 0
            got = np.bincount(tree.feature[inner], tree.gain[inner], len(x))
            gains += got / max(1e-300, got.sum()) if leaf is None else got
            for d in spec.depths:
                for side, rows, y in ((0, tx, ty), (1, ax, ay)):
                    said = above[d] if d < len(above) else tree.value[tree.walk(rows, d - len(above))]
                    errors[d][side] += float(((y - said) ** 2).sum())
        ids = [np.tile(row_id[asked], len(sizes)), np.arange(len(x)), *[np.array([d, d]) for d in spec.depths]]
        values = [(sums / np.array(sizes)[:, None]).ravel(), gains / spec.trees, *[np.array(errors[d]) for d in spec.depths]]
        gain = "gain" if leaf is None else f"gain {slots[slot][1][0]}"
        kinds = [k for n in (*[f"score@{n}" for n in sizes[:-1]], "score") for k in [n] * len(asked)] \
            + [gain] * len(x) + ["train error", "held error"] * len(spec.depths)
        return pa.table([pa.array(np.full(len(kinds), i, np.int32)), pa.array(kinds),
                         pa.array(np.concatenate(ids).astype(np.int64)),
                         pa.array(np.concatenate(values).astype(np.float64))], schema=_SUMS)

    return run


def _slot_table(specs, slots):
    """Task: grows a slot's trees and returns them."""

    def run(table):
        slot, i, _, _, _, _, trees = _slot_trees(table, specs, slots)
        return pa.Table.from_pylist([{"slot": slot, "spec": i, "tree": t, **{c: getattr(tree, c).tolist() for c in (
            "feature", "threshold", "left", "right", "value", "gain")}} for t, tree in trees], schema=_TREES)

    return run


_TREES = pa.schema([("slot", pa.int32()), ("spec", pa.int32()), ("tree", pa.int32()), ("feature", pa.list_(pa.int64())),
                    ("threshold", pa.list_(pa.float64())), ("left", pa.list_(pa.int64())),
                    ("right", pa.list_(pa.int64())), ("value", pa.list_(pa.float64())), ("gain", pa.list_(pa.float64()))])
_TREES_SQL = ("slot int, spec int, tree int, feature array<long>, threshold array<double>, left array<long>, "
              "right array<long>, value array<double>, gain array<double>")


def _planned(rows: DataFrame, specs: list[Forest], task_cells: int, edges=None):
    """Matrix rows, features, upper nodes and slots."""
    folds = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    first = rows.select(F.octet_length("x").alias("b")).first()
    p = first["b"] // 4 if first else 0
    every = sum(n for f, n in folds.items() if f > 0)
    n_train = {i: every - (folds.get(s.fold, 0) if s.fold is not None else 0) for i, s in enumerate(specs)}
    tops = _tops(rows, specs, n_train, p, task_cells, edges)
    tasks = 8 * rows.sparkSession.sparkContext.defaultParallelism
    return p, tops, _slots(specs, tops, tasks)


def _dealt(rows: DataFrame, specs, tops, slots) -> DataFrame:
    dealt = rows.mapInArrow(_deal(specs, tops, slots), "slot int, row_id long, fold int, label double, x binary")
    return dealt.repartitionById(max(1, min(len(slots), 4096)), F.col("slot"))      # no two slots wait for one task


def forests(rows: DataFrame, specs: list[Forest], task_cells: int = TASK_CELLS, edges=None) -> DataFrame:
    """Grow all ``specs`` over matrix rows at once; returns the sums ``(spec, kind, id, value)``.

    ``score``: a row's mean prediction, by row_id. ``gain``: a feature's share
    of the fall of the squared error, mean over trees, by feature number.
    ``train error``, ``held error``: squared errors of the trees cut at a
    depth, by depth (for one tree). ``spec`` is the place in the list.
    ``edges`` gives the rows' thresholds where they are known (as ``edges_of``).
    """
    p, tops, slots = _planned(rows, specs, task_cells, edges)
    if not p:
        return rows.sparkSession.createDataFrame([], SUMS)
    parts = _dealt(rows, specs, tops, slots).groupBy("slot").applyInArrow(_slot_sums(specs, slots), SUMS)
    upper = [(i, f"gain {t}", node.split[0], node.gain) for (i, t), top in tops.items() for node in top.inner()]
    if not upper:
        return parts.groupBy("spec", "kind", "id").agg(F.sum("value").alias("value"))
    # a tree in several parts: the falls add up first, then the shares' mean over trees
    trees = F.element_at(F.array(*[F.lit(float(s.trees)) for s in specs]), F.col("spec") + 1)
    falls = F.when(F.col("kind").startswith("gain "), F.col("value") * trees).otherwise(F.col("value"))
    total = parts.withColumn("value", falls).unionByName(rows.sparkSession.createDataFrame(upper, SUMS)) \
        .groupBy("spec", "kind", "id").agg(F.sum("value").alias("value"))
    split = F.col("kind").startswith("gain ")
    whole = total.where(split).groupBy("spec", "kind").agg(F.sum("value").alias("whole"))
    shares = total.where(split).join(whole, ["spec", "kind"]).select(
        "spec", F.lit("gain").alias("kind"), "id", (F.try_divide("value", "whole") / trees).alias("value"))
    return total.where(~split).unionByName(shares).groupBy("spec", "kind", "id").agg(F.sum("value").alias("value"))


@dataclass
class Grown:
    """Kept trees: a table with a row for each tree (or each part below its upper nodes)."""

    specs: list
    tops: dict
    slots: list
    trees: DataFrame

    def predict(self, rows: DataFrame) -> DataFrame:
        """``(spec, row_id, prediction)`` of matrix rows by every spec."""
        specs, slots = [Forest(**{**s.__dict__, "fold": None}) for s in self.specs], self.slots

        def run(key, some, trees):
            out = _SUMS.empty_table()
            if len(some) and len(trees):
                row_id, _, _, x = _arrays(some)
                total = np.zeros(len(row_id))
                for r in trees.to_pylist():
                    tree = Tree(*[np.array(r[c]) for c in ("feature", "threshold", "left", "right", "value", "gain")])
                    total += tree.value[tree.walk(x)]
                n = len(row_id)
                out = pa.table([pa.array(np.full(n, slots[key[0].as_py()][0], np.int32)), pa.array(["score"] * n),
                                pa.array(row_id), pa.array(total)], schema=_SUMS)
            return out

        sent = _dealt(rows, specs, self.tops, slots)
        sums = sent.groupBy("slot").cogroup(self.trees.groupBy("slot")).applyInArrow(run, SUMS)
        n = F.element_at(F.array(*[F.lit(float(s.trees)) for s in specs]), F.col("spec") + 1)
        return sums.groupBy("spec", F.col("id").alias("row_id")).agg(F.sum("value").alias("v")).select(
            "spec", "row_id", (F.col("v") / n).alias("prediction"))


def fit(rows: DataFrame, specs: list[Forest], task_cells: int = TASK_CELLS) -> Grown:
    """Grow all ``specs`` and keep the trees (a checkpointed table), to predict other rows later."""
    p, tops, slots = _planned(rows, specs, task_cells)
    trees = _dealt(rows, specs, tops, slots).groupBy("slot").applyInArrow(_slot_table(specs, slots), _TREES_SQL)
    return Grown(specs, tops, slots, cut_lineage(trees))


# ---- boosting ------------------------------------------------------------------------------------------------
#: A booster whose training rows hold at most this many values is fitted in one task: up to there its steps, each of
#: which needs the one before, take less time than the jobs that would sum their histograms.
BOOST_CELLS = 16_000_000
#: Steps of a booster over larger tables between two checkpoints of its predictions.
STEPS_A_CHECKPOINT = 10


@dataclass(frozen=True)
class Booster:
    """Gradient boosting of squared error: each tree fits the residuals, and ``rate`` times its values are added.

    Splits lie at ``BINS`` thresholds a feature. ``subsample``: share of the rows, by a hash, that a step's tree sees.
    ``prefixes``: predictions after the first so many steps as well (kind ``score@n``).
    """

    name: str
    steps: int = 300
    rate: float = 0.05
    max_depth: int = 5
    min_leaf: int = 1
    subsample: float = 1.0
    seed: int = 42
    fold: int | None = None
    prefixes: tuple = ()


class _Level:
    """The growing tree of one step, level by level, from histograms ``(count, sum)`` of its nodes.

    Only the smaller child of a split is counted; the larger one is its parent less that.
    """

    def __init__(self, spec: Booster, starts: np.ndarray):
        self.spec, self.starts = spec, starts
        self.feature, self.bin, self.left, self.right = [-1], [0], [0], [0]
        self.value, self.gain = [0.0], [0.0]
        self.open, self.known, self.want = [0], {}, [0]     # nodes of this level, their histograms, those to count
        self.depth = 0

    def walk(self, codes: np.ndarray) -> np.ndarray:
        """Node of every column of bin numbers."""
        feature, cut = np.array(self.feature), np.array(self.bin)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(codes.shape[1], np.int64)
        live = np.nonzero(feature[at] >= 0)[0]
        while len(live):
            node = at[live]
            at[live] = np.where(codes[feature[node], live] <= cut[node], left[node], right[node])
            live = live[feature[at[live]] >= 0]
        return at

    def add(self, found: dict) -> None:
        """Takes the histograms of ``want`` and splits the level's nodes."""
        self.known.update(found)
        for smaller, larger, parent in getattr(self, "pairs", ()):
            self.known[larger] = tuple(a - b for a, b in zip(parent, self.known[smaller]))
        nodes = self.open
        count, total = (np.stack([self.known[n][j] for n in nodes]) for j in (0, 1))
        f, c, top, sl, wl = split_histograms(count, total, self.starts, self.spec.min_leaf)
        n, s = (v[:, :self.starts[1]].sum(axis=1) for v in (count, total))
        known, pairs, opened = {}, [], []
        for k, node in enumerate(nodes):
            self.value[node] = s[k] / max(n[k], 1e-300)
            gain = top[k] if f[k] >= 0 else 0.0
            if gain <= 1e-12 * s[k] ** 2 / max(n[k], 1e-300) or self.depth >= self.spec.max_depth:
                continue
            a, b = len(self.feature), len(self.feature) + 1
            self.feature[node], self.bin[node], self.left[node], self.right[node] = int(f[k]), int(c[k]), a, b
            self.gain[node] = gain
            for m, x in ((wl[k], sl[k]), (n[k] - wl[k], s[k] - sl[k])):
                self.feature.append(-1)
                self.bin.append(0)
                self.left.append(0)
                self.right.append(0)
                self.value.append(x / m)
                self.gain.append(0.0)
            pairs.append((a, b, self.known[node]) if wl[k] <= n[k] - wl[k] else (b, a, self.known[node]))
            opened += [a, b]
        self.depth += 1
        self.pairs, self.known = pairs, known
        # at the last depth nothing is split: the children's values are known already
        self.open, self.want = (opened, [q[0] for q in pairs]) if self.depth < self.spec.max_depth else ([], [])

    def result(self) -> tuple:
        return tuple(np.array(v) for v in (self.feature, self.bin, self.left, self.right, self.value, self.gain))


def _walk_codes(tree: tuple, codes: np.ndarray) -> np.ndarray:
    feature, cut, left, right = tree[:4]
    at = np.zeros(codes.shape[1], np.int64)
    live = np.nonzero(feature[at] >= 0)[0]
    while len(live):
        node = at[live]
        at[live] = np.where(codes[feature[node], live] <= cut[node], left[node], right[node])
        live = live[feature[at[live]] >= 0]
    return at


def _histograms(codes: np.ndarray, node: np.ndarray, residual: np.ndarray, want: list, starts: np.ndarray) -> dict:
    """``(count, sum)`` by bin of every wanted node; ``codes`` are bin numbers, features by rows."""
    number = np.full(max(int(node.max(initial=0)), max(want)) + 1, -1)
    number[want] = np.arange(len(want))
    mine = number[node]
    at = np.flatnonzero(mine >= 0)
    whole = len(at) == codes.shape[1]
    mine, r = mine[at], residual[at]
    count, total = np.empty((len(want), starts[-1])), np.empty((len(want), starts[-1]))
    for f, c in enumerate(codes):
        a, b = starts[f], starts[f + 1]
        index = mine * (b - a)
        index += c if whole else c.take(at)
        count[:, a:b] = np.bincount(index, minlength=len(want) * (b - a)).reshape(-1, b - a)
        total[:, a:b] = np.bincount(index, r, len(want) * (b - a)).reshape(-1, b - a)
    return {w: (count[k], total[k]) for k, w in enumerate(want)}


def _seen(row_id: np.ndarray, spec: Booster, step: int) -> np.ndarray:
    """Rows that the tree of a step sees."""
    if spec.subsample >= 1.0:
        return np.ones(len(row_id), bool)
    with np.errstate(over="ignore"):
        u = _uniform(_mix(row_id.astype(np.int64).view(np.uint64) * _M1 + root_key(spec.seed, step)))
    return u < spec.subsample


def _boost_sums(i, row_id, asked, stages, losses, gains):
    ids = [np.tile(row_id[asked], len(stages)), np.arange(1, len(losses) + 1), np.arange(len(gains))]
    kinds = [k for k in stages for _ in range(int(asked.sum()))] + ["loss"] * len(losses) + ["gain"] * len(gains)
    values = [*[v[asked] for v in stages.values()], np.array(losses), gains / max(1e-300, gains.sum())]
    return pa.table([pa.array(np.full(len(kinds), i, np.int32)), pa.array(kinds),
                     pa.array(np.concatenate(ids).astype(np.int64)),
                     pa.array(np.concatenate(values).astype(np.float64))], schema=_SUMS)


def _boost_task(specs, edges, p):
    """Task: all steps of one booster."""

    def run(table):
        i = table["slot"][0].as_py()
        spec = specs[i]
        row_id, fold, label, x = _arrays(table.sort_by("row_id"))
        train, asked = _trains(fold, spec), _asked(fold, spec)
        codes = codes_of(x, edges)
        own, starts = np.ascontiguousarray(codes[:, train]), bin_starts(edges)
        said = np.full(len(label), label[train].mean())
        losses, gains, stages = [], np.zeros(p), {}
        for step in range(spec.steps):
            residual = (label - said)[train]
            seen = _seen(row_id[train], spec, step)
            tree, node = _Level(spec, starts), np.zeros(len(residual), np.int64)
            while tree.want:
                nowhere = len(tree.feature)         # rows that this step does not see
                tree.add(_histograms(own, node if seen.all() else np.where(seen, node, nowhere), residual, tree.want, starts))
                if tree.open:
                    node = tree.walk(own)
            grown = tree.result()
            said = said + spec.rate * grown[4][_walk_codes(grown, codes)]
            inner = grown[0] >= 0
            gains += np.bincount(grown[0][inner], grown[5][inner], p)
            losses.append(float(((label - said)[train] ** 2).mean()))
            if step + 1 in spec.prefixes:
                stages[f"score@{step + 1}"] = said
        return _boost_sums(i, row_id, asked, {**stages, "score": said}, losses, gains)

    return run


def _boost_jobs(rows: DataFrame, specs: list[tuple], edges, p) -> DataFrame:
    """Boosters whose rows do not fit a task: a job for each level sums the histograms of all boosters' nodes."""
    spark, starts = rows.sparkSession, bin_starts(edges)
    only, cells = [s for _, s in specs], int(starts[-1])
    means = {}
    for r in rows.where("fold > 0").groupBy("fold").agg(F.sum("label").alias("s"), F.count("*").alias("n")).collect():
        means[r["fold"]] = (r["s"], r["n"])

    def coded(batches):
        for b in batches:
            _, fold, _, x = _arrays(b)
            cells = [c.tobytes() for c in codes_of(x, edges).T] if len(fold) else []
            said = [first] * len(fold)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row_id", "fold", "label")],
                                              pa.array(cells, pa.binary()), pa.array(said, pa.list_(pa.float64()))],
                                             names=["row_id", "fold", "label", "codes", "said"])

    first = []
    for s in only:
        use = [v for f, v in means.items() if s.fold is None or f != s.fold]
        first.append(sum(v[0] for v in use) / sum(v[1] for v in use))
    schema = "row_id long, fold int, label double, codes binary, said array<double>"
    state = cut_lineage(rows.mapInArrow(coded, schema))

    def parts(b):
        row_id, fold, label = (np.asarray(b.column(c)) for c in ("row_id", "fold", "label"))
        codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(row_id), -1).T
        said = np.array(b.column("said").to_pylist()).reshape(len(row_id), -1)
        return row_id, fold, label, codes, said

    def later(codes, said, new):
        said = said.copy()
        for k, s in enumerate(only):
            for tree in new[k]:
                said[:, k] += s.rate * tree[4][_walk_codes(tree, codes)]
        return said

    def level(growing, new, step):
        wants = [(k, w) for k, g in enumerate(growing) for w in g.want]

        def run(batches):
            add = np.zeros((len(wants), 2 * cells))
            for b in batches:
                if not b.num_rows:
                    continue
                row_id, fold, label, codes, said = parts(b)
                said = later(codes, said, new)
                for k, s in enumerate(only):
                    mine = [j for j, (q, _) in enumerate(wants) if q == k]
                    use = np.nonzero(_trains(fold, s) & _seen(row_id, s, step))[0]
                    if not mine or not len(use):
                        continue
                    own = np.ascontiguousarray(codes[:, use])
                    got = _histograms(own, growing[k].walk(own), (label - said[:, k])[use], [wants[j][1] for j in mine],
                                      starts)
                    for j in mine:
                        add[j] += np.concatenate(got[wants[j][1]])
            none = [b""] * len(wants)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(wants), dtype=np.int32)),
                                              pa.array([a.tobytes() for a in add], pa.binary()), pa.array(none, pa.binary()),
                                              pa.array(none, pa.binary())], names=["node", "add", "low", "high"])

        # at most 2^(max_depth - 1) nodes a booster, whatever the number of rows
        for r in _sum_arrays(state.mapInArrow(run, "node int, add binary, low binary, high binary")).collect():
            k, w = wants[r["node"]]
            a = np.frombuffer(bytes(r["add"]), np.float64).reshape(2, cells)
            found.setdefault(k, {})[w] = (a[0], a[1])

    def advance(new, base, out):
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                row_id, fold, label, codes, said = parts(b)
                lost = np.zeros((len(only), max(map(len, new))))
                for k, s in enumerate(only):
                    train = _trains(fold, s)
                    for j, tree in enumerate(new[k]):
                        said[:, k] += s.rate * tree[4][_walk_codes(tree, codes)]
                        lost[k, j] = ((label - said[:, k])[train] ** 2).sum()
                if out == "state":
                    yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row_id", "fold", "label", "codes")],
                                                      pa.array(list(said), pa.list_(pa.float64()))],
                                                     names=["row_id", "fold", "label", "codes", "said"])
                else:
                    k, j = np.meshgrid(np.arange(len(only)), np.arange(lost.shape[1]), indexing="ij")
                    yield pa.RecordBatch.from_arrays([pa.array(k.ravel().astype(np.int32)), pa.array(["loss"] * k.size),
                                                      pa.array(j.ravel() + base + 1), pa.array(lost.ravel())],
                                                     names=_SUMS.names)
        return run

    new: list[list] = [[] for _ in only]
    gains, losses, most, base = np.zeros((len(only), p)), [], max(s.steps for s in only), 0
    scores: list[DataFrame] = []
    for step in range(most):
        growing = [_Level(s, starts) for s in only]
        for k, s in enumerate(only):
            if step >= s.steps:
                growing[k].want = growing[k].open = []
        while any(g.want for g in growing):
            found: dict[int, dict] = {}
            level(growing, new, step)
            for k, g in enumerate(growing):
                if g.want:
                    g.add(found[k])
        for k, s in enumerate(only):
            if step < s.steps:
                tree = growing[k].result()
                new[k].append(tree)
                gains[k] += np.bincount(tree[0][tree[0] >= 0], tree[5][tree[0] >= 0], p)
        ends = {k for k, s in enumerate(only) if step + 1 in (*s.prefixes, s.steps) and step < s.steps}
        if ends or step + 1 - base >= STEPS_A_CHECKPOINT:
            summed = state.mapInArrow(advance(new, base, "loss"), SUMS).groupBy("spec", "kind", "id").agg(
                F.sum("value").alias("value"))
            losses += [tuple(r) for r in summed.collect()]      # one row a step and booster
            state = cut_lineage(state.mapInArrow(advance(new, base, "state"), schema))
            base, new = step + 1, [[] for _ in only]
            for k in ends:
                i, s = specs[k]
                asked = F.lit(True) if s.fold is None else F.col("fold") == s.fold
                scores.append(state.where(asked).select(
                    F.lit(i).alias("spec"), F.lit("score" if step + 1 == s.steps else f"score@{step + 1}").alias("kind"),
                    F.col("row_id").alias("id"), F.col("said")[k].alias("value")))
    rows_of = {k: sum(v[1] for f, v in means.items() if s.fold is None or f != s.fold) for k, s in enumerate(only)}
    small = [(specs[k][0], "loss", i, v / rows_of[k]) for k, _, i, v in losses if i <= only[k].steps]
    small += [(specs[k][0], "gain", f, float(v / max(1e-300, gains[k].sum()))) for k in range(len(only))
              for f, v in enumerate(gains[k])]
    out = spark.createDataFrame(small, SUMS)
    for part in scores:
        out = out.unionByName(part)
    return out


def boosters(rows: DataFrame, specs: list[Booster], boost_cells: int = BOOST_CELLS, edges=None) -> DataFrame:
    """Fit all ``specs`` over matrix rows; returns the sums ``(spec, kind, id, value)``.

    ``score``: a row's prediction, by row_id. ``loss``: mean squared error of
    the training rows after each step, from the one fit. ``gain``: a feature's
    share of the fall of the squared error. ``edges`` as in ``forests``.
    """
    first = rows.select(F.octet_length("x").alias("b")).first()
    p = first["b"] // 4 if first else 0
    n = rows.where("fold > 0").count()
    if not p or not n:
        return rows.sparkSession.createDataFrame([], SUMS)
    edges = edges_of(rows, p) if edges is None else edges()
    if n * p > boost_cells:
        return _boost_jobs(rows, list(enumerate(specs)), edges, p)

    def deal(batches):
        for b in batches:
            fold = np.asarray(b.column("fold"))
            for i, s in enumerate(specs):
                at = np.nonzero(_trains(fold, s) | _asked(fold, s))[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), *b.take(pa.array(at)).columns],
                                                 names=["slot", *[n for n, _ in _ROW]])

    sent = rows.mapInArrow(deal, "slot int, row_id long, fold int, label double, x binary")
    return sent.repartitionById(len(specs), F.col("slot")).groupBy("slot").applyInArrow(_boost_task(specs, edges, p), SUMS)


def _ship_by_value() -> None:
    """Python workers may not have this package: send the functions above by value."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
