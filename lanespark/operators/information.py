"""Mutual information by k nearest neighbours (FP-08).

For every feature the points (feature, target) are scaled to unit deviation
and shifted by a tiny normal noise, a hash of the row and the column, which
breaks ties. The k-th neighbour's distance in the maximum norm and the numbers
of points within that distance along either axis give the estimate
``psi(n) + psi(k) - mean(psi(nx) + psi(ny))``.

The plane of a feature is cut by a k-d tree of a bounded sample into leaves of
bounded size. A task finds each point's k nearest within its leaf; where the
square around a point reaches other leaves, these are asked as well. The
counts along an axis are ranks: points and both ends of every point's interval
are sorted together over the cluster, and a running count of the points is
carried through each partition and from one to the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Most leaves of a feature's plane; the tree is fitted on about 16 drawn rows a leaf.
MOST_LEAVES = 2048


def digamma(m: Column) -> Column:
    """Digamma of a positive number, to 12 digits: ten steps up, then the asymptotic series."""
    z = m + F.lit(10.0)
    z2 = z * z
    series = F.log(z) - F.lit(0.5) / z - (F.lit(1 / 12) - (F.lit(1 / 120) - (F.lit(1 / 252) - F.lit(1 / 240) / z2) / z2)
                                          / z2) / z2
    for i in range(10):
        series = series - F.lit(1.0) / (m + F.lit(float(i)))
    return series


def _noise(row: Column, column: Column) -> Column:
    """Standard normal number of a row and column by hashes."""
    u = [(F.pmod(F.xxhash64(row, column, F.lit(s)), F.lit(1 << 53)).cast("double") + F.lit(0.5)) / F.lit(2.0 ** 53)
         for s in (1, 2)]
    return F.sqrt(F.lit(-2.0) * F.log(u[0])) * F.cos(F.lit(2 * np.pi) * u[1])


def scaled(rows: DataFrame, p: int, x: str = "x", y: str = "label") -> DataFrame:
    """``row_id, v``: the p features and the target over their deviation (0: 1), with noise; rows need ``row_id``."""
    cols = F.concat(F.col(x), F.array(F.col(y)))
    wide = rows.select(F.col("row_id").cast("long").alias("row_id"), cols.alias("v"))
    s = wide.agg(*[F.stddev_pop(F.col("v")[i]).alias(f"s{i}") for i in range(p + 1)],
                 *[F.avg(F.abs(F.col("v")[i])).alias(f"a{i}") for i in range(p + 1)]).first()
    sd = [float(s[f"s{i}"] or 0.0) or 1.0 for i in range(p + 1)]
    amp = [1e-10 * max(1.0, float(s[f"a{i}"] or 0.0) / sd[i]) for i in range(p + 1)]
    return wide.select("row_id", F.array(*[
        F.col("v")[i] / F.lit(sd[i]) + F.lit(amp[i]) * _noise(F.col("row_id"), F.lit(i)) for i in range(p + 1)]).alias("v"))


def _trees(sample: np.ndarray, p: int, depth: int) -> np.ndarray:
    """For every feature a complete k-d tree over (feature, target): axis and cut of the nodes, heap order."""
    out = np.zeros((p, (1 << depth) - 1, 2))
    for f in range(p):
        sets = [sample[:, [f, p]]]
        for node in range((1 << depth) - 1):
            at = sets[node]
            axis = int(np.argmax(np.ptp(at, axis=0))) if len(at) else 0
            cut = float(np.median(at[:, axis])) if len(at) else 0.0
            out[f, node] = axis, cut
            sets += [at[at[:, axis] <= cut], at[at[:, axis] > cut]]
    return out


def _reach(tree: np.ndarray, depth: int, xy: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(point, leaf)`` of all leaves that the open square of half side r around each point meets."""
    point, node = np.arange(len(xy)), np.zeros(len(xy), np.int64)
    for _ in range(depth):
        axis, cut = tree[node, 0].astype(np.int64), tree[node, 1]
        v = xy[point, axis]
        reach = r[point] + 1e-12 * (np.abs(v) + r[point])
        low, high = v - reach <= cut, v + reach > cut
        point, node = np.concatenate([point[low], point[high]]), np.concatenate([2 * node[low] + 1, 2 * node[high] + 2])
    return point, node - ((1 << depth) - 1)


def _nearest(xy: np.ndarray, to: np.ndarray, k: int, within: np.ndarray | None, own: bool) -> np.ndarray:
    """The k smallest maximum-norm distances (ascending, inf where there are fewer) from points to ``to``.

    ``within`` bounds each point's distances from above; without it a bound
    comes from the neighbours in either axis' order. ``own``: ``xy`` is ``to``
    and no point is its own neighbour.
    """
    n, m = len(xy), len(to)
    best = np.full((n, k), np.inf)
    orders = [np.argsort(to[:, a], kind="stable") for a in (0, 1)]
    if within is None:
        within = np.full(n, np.inf)
        for a, order in enumerate(orders):
            rank = np.empty(m, np.int64)
            rank[order] = np.arange(m)
            at = rank[:, None] + np.concatenate([np.arange(-2 * k, 0), np.arange(1, 2 * k + 1)])
            ok = (at >= 0) & (at < m)
            d = np.abs(to[order[np.clip(at, 0, m - 1)]] - xy[:, None, :]).max(axis=2)
            d = np.sort(np.where(ok, d, np.inf), axis=1)
            if d.shape[1] >= k:
                within = np.minimum(within, d[:, k - 1])
    spans = []
    for a, order in enumerate(orders):
        line = to[order, a]
        with np.errstate(invalid="ignore"):
            # a little outward, so that rounding never misses a distance equal to the bound
            reach = within + 1e-12 * (np.abs(xy[:, a]) + within)
            low, high = xy[:, a] - reach, xy[:, a] + reach
        spans.append((np.searchsorted(line, low), np.searchsorted(line, high, side="right")))
    width = np.stack([b - a for a, b in spans])
    axis = width.argmin(axis=0)
    size = width.min(axis=0)
    todo = np.argsort(size, kind="stable")
    at = 0
    while at < n:
        part = todo[at:at + max(1, 2_000_000 // max(1, int(size[todo[min(n - 1, at + 20_000)]])))][:20_000]
        at += len(part)
        w = max(k + 1, int(size[part].max()))
        for a in (0, 1):
            mine = part[axis[part] == a]
            if not len(mine):
                continue
            place = spans[a][0][mine][:, None] + np.arange(w)
            ok = place < spans[a][1][mine][:, None]
            j = orders[a][np.minimum(place, m - 1)]
            d = np.abs(to[j] - xy[mine][:, None, :]).max(axis=2)
            if own:
                ok &= j != mine[:, None]
            d = np.where(ok, d, np.inf)
            best[mine] = np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1)
    return best


def _ordered(v: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles (its own inverse through ``_double``)."""
    bits = (v + 0.0).view(np.int64)
    return np.where(bits >= 0, bits, np.int64(-2 ** 63) - bits)


def _double(i: np.ndarray) -> np.ndarray:
    return np.where(i >= 0, i, np.int64(-2 ** 63) - i).view(np.float64)


def _ends(v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers a < v < b so that just the numbers between them lie nearer to v than r (in double arithmetic).

    The rounded difference to v grows with the number, so its first value that reaches r is found by halving.
    """

    def first(w):       # the least double b above w with b - w >= r
        low, high = _ordered(w), _ordered(w + 2 * r + np.abs(w) * 1e-15)
        for _ in range(64):
            middle = (low & high) + ((low ^ high) >> 1)
            far = _double(middle) - w >= r
            low, high = np.where(far, low, np.minimum(middle + 1, high)), np.where(far, middle, high)
        return _double(high)

    return -first(-v), first(v)


def _radii(points: DataFrame, p: int, n: int, k: int, leaf_rows: int, seed: int) -> DataFrame:
    """``(feature, row_id, px, py, r)``: the distance of every point's k-th neighbour."""
    depth = max(0, int(np.ceil(np.log2(max(1, min(MOST_LEAVES, n / leaf_rows))))))
    trees = None
    if depth:
        share = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = points.where(share < min(1.0, 16 * (1 << depth) / n)).select("v").collect()
        trees = _trees(np.array([r["v"] for r in drawn] or np.zeros((0, p + 1)), float).reshape(-1, p + 1), p, depth)

    def leaf_of(xy, f):
        if not depth:
            return np.zeros(len(xy), np.int64)
        node = np.zeros(len(xy), np.int64)
        for _ in range(depth):
            axis, cut = trees[f, node, 0].astype(np.int64), trees[f, node, 1]
            node = 2 * node + 1 + (xy[np.arange(len(xy)), axis] > cut)
        return node - ((1 << depth) - 1)

    names = ["feature", "leaf", "row_id", "px", "py"]

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            row = np.asarray(b.column(0))
            v = b.column(1).flatten().to_numpy().reshape(len(row), p + 1)
            for f in range(p):
                xy = v[:, [f, p]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), f, np.int32)),
                                                  pa.array(leaf_of(xy, f).astype(np.int32)), pa.array(row),
                                                  pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], names=names)

    placed = points.select("row_id", "v").mapInArrow(place, "feature int, leaf int, row_id long, px double, py double")

    def inner(table):
        xy = np.stack([table["px"].to_numpy(), table["py"].to_numpy()], axis=1)
        d = _nearest(xy, xy, k, None, True)
        return table.append_column("d", pa.array(list(d), pa.list_(pa.float64())))

    found = cut_lineage(placed.groupBy("feature", "leaf").applyInArrow(
        inner, "feature int, leaf int, row_id long, px double, py double, d array<double>"))
    kth = F.element_at("d", k)
    if not depth:
        return found.select("feature", "row_id", "px", "py", kth.alias("r"))

    def ask(batches):
        for b in batches:
            if not b.num_rows:
                continue
            feature, leaf, row, px, py, r = (np.asarray(b.column(i)) for i in range(6))
            for f in np.unique(feature):
                at = np.nonzero(feature == f)[0]
                point, to = _reach(trees[f], depth, np.stack([px[at], py[at]], axis=1), r[at])
                other = to != leaf[at[point]]
                i = at[point[other]]
                yield pa.RecordBatch.from_arrays([pa.array(feature[i]), pa.array(to[other].astype(np.int32)),
                                                  *[pa.array(c[i]) for c in (row, px, py, r)]], names=[*names, "r"])

    asked = found.select("feature", "leaf", "row_id", "px", "py", kth.alias("r")).mapInArrow(
        ask, "feature int, leaf int, row_id long, px double, py double, r double")

    def answer(key, some, held):
        if not len(some) or not len(held):
            return pa.table({"feature": pa.array([], pa.int32()), "row_id": pa.array([], pa.int64()),
                             "d": pa.array([], pa.list_(pa.float64()))})
        xy, to = (np.stack([t["px"].to_numpy(), t["py"].to_numpy()], axis=1) for t in (some, held))
        d = _nearest(xy, to, k, some["r"].to_numpy(), False)
        return pa.table({"feature": some["feature"], "row_id": some["row_id"],
                         "d": pa.array(list(d), pa.list_(pa.float64()))})

    answers = asked.groupBy("feature", "leaf").cogroup(found.select(*names).groupBy("feature", "leaf")).applyInArrow(
        answer, "feature int, row_id long, d array<double>")
    more = answers.groupBy("feature", "row_id").agg(F.flatten(F.collect_list("d")).alias("more"))   # a few leaves each
    both = found.join(more, ["feature", "row_id"], "left")
    every = F.array_sort(F.concat("d", F.coalesce("more", F.array().cast("array<double>"))))
    return both.select("feature", "row_id", "px", "py", F.element_at(every, k).alias("r"))


def _counts(radii: DataFrame, p: int) -> DataFrame:
    """``(feature, row_id, axis, n)``: points strictly nearer than r along either axis, the point itself included."""

    def events(batches):
        # line: the feature's number, or p for the target's axis, which all features share
        for b in batches:
            if not b.num_rows:
                continue
            feature, row, px, py, r = (np.asarray(b.column(i)) for i in range(5))
            first = feature == 0
            out = [(feature, feature, row, px, np.ones(len(row), np.int32)),
                   (np.full(first.sum(), p, np.int32), feature[first], row[first], py[first], np.ones(first.sum(), np.int32))]
            for line, v in ((feature, px), (np.full(len(row), p, np.int32), py)):
                low, high = _ends(v, r)
                # of equal values: first the ends that count what is below, then points, then ends that count them too
                out += [(line, feature, row, high, np.zeros(len(row), np.int32)),
                        (line, feature, row, low, np.full(len(row), 2, np.int32))]
            cols = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (
                np.int32, np.int32, np.int64, np.float64, np.int32))], names=["line", "feature", "row_id", "value", "kind"])

    line = radii.select("feature", "row_id", "px", "py", "r").mapInArrow(
        events, "line int, feature int, row_id long, value double, kind int")
    order = ["line", "value", "kind", "feature", "row_id"]
    ranged = line.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        part = TaskContext.get().partitionId()
        before: dict[int, int] = {}

        def rows(line, feature, row, sign, n, total):
            return pa.RecordBatch.from_arrays(
                [pa.array(c.astype(t)) for c, t in zip((np.full(len(line), part), line, feature, row, sign, n),
                                                       (np.int32, np.int32, np.int32, np.int64, np.int32, np.int64))]
                + [pa.array([total] * len(line), pa.bool_())],
                names=["part", "line", "feature", "row_id", "sign", "n", "total"])

        for b in batches:
            line, feature, row, _, kind = (np.asarray(b.column(i)) for i in range(5))
            point = kind == 1
            run_n = np.cumsum(point)
            for s in np.unique(line):
                here = np.nonzero(line == s)[0]
                a, z = here[0], here[-1]        # sorted by line
                base = before.get(int(s), 0) - (run_n[a] - point[a])
                at = here[kind[here] != 1]
                if len(at):
                    yield rows(line[at], feature[at], row[at], np.where(kind[at] == 0, 1, -1), run_n[at] + base, False)
                before[int(s)] = int(run_n[z] + base)
        if before:
            lines = np.array(sorted(before))
            zero = np.zeros(len(lines), np.int64)
            yield rows(lines, zero, zero, zero, np.array([before[int(s)] for s in lines]), True)

    seen = cut_lineage(ranged.mapInArrow(
        run, "part int, line int, feature int, row_id long, sign int, n long, total boolean"))
    totals = seen.where("total").select("part", "line", F.col("n").alias("here"))
    earlier = Window.partitionBy("line").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", "line", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"))
    # one row for each partition and line
    ends = seen.where(~F.col("total")).join(F.broadcast(offsets), ["part", "line"])
    return ends.groupBy("feature", "row_id", (F.col("line") == p).cast("int").alias("axis")).agg(
        F.sum(F.col("sign") * (F.col("n") + F.col("before"))).alias("n"))


def knn_mutual_information(rows: DataFrame, names: list[str], k: int = 5, x: str = "x", y: str = "label",
                           leaf_rows: int = 8192, seed: int = 3) -> DataFrame:
    """FP-08: ``(feature, mi_score)`` of every feature in the array ``x`` with the target ``y``.

    ``rows`` has a ``row_id`` of its own for each row. At most n - 1 neighbours are used; fewer than two rows give 0.
    """
    p, spark = len(names), rows.sparkSession
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([(f, 0.0) for f in names], "feature string, mi_score double")
    k = min(k, n - 1)
    points = cut_lineage(scaled(rows, p, x, y))
    counts = _counts(cut_lineage(_radii(points, p, n, k, leaf_rows, seed)), p)
    mean = counts.groupBy("feature", "axis").agg(F.avg(digamma(F.col("n").cast("double"))).alias("m")) \
        .groupBy("feature").agg(F.sum("m").alias("m"))
    known = digamma(F.lit(float(n))) + digamma(F.lit(float(k)))
    label = F.element_at(F.array(*[F.lit(f) for f in names]), F.col("feature") + 1)
    return mean.select(label.alias("feature"), F.greatest(F.lit(0.0), known - F.col("m")).alias("mi_score"))


def _ship_by_value() -> None:
    """Python workers may not have this package: send the functions above by value."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
