"""Exact quantiles by rank selection over histograms.

No task holds a column's values or a map of them. The range of every column
(and group) is cut into buckets; one hash aggregate counts them and
notes each bucket's least and greatest value. The buckets that hold a wanted
rank are the next ranges. A bucket of one value is an answer, however many
rows share it; a bucket of few rows is sorted; any other is cut again. A cut
always separates its least from its greatest value, so it ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Ranges of up to this many rows go to every task; there are at most two for each group, column and share.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    """``df`` (stored), to be broadcast if it is small; otherwise Spark plans the join by what it measures."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _scaled(v: Column) -> Column:
    """Signed logarithm that rises with every double (log2 is above -1075 for all but zero)."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log2(F.abs(v)) + F.lit(1100.0)))


def _bucket(v: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """Bucket of a value between ``lo`` and ``hi``; infinities and NaN, the greatest, have buckets of their own.

    Buckets are equal in width where the ends differ by a factor of at most
    two, else in the logarithm: numbers of all sizes are cut at most six times
    or so, not once for every few powers of ten.
    """
    inf = F.lit(float("inf"))
    near = ((lo > 0) & (hi / 2 <= lo)) | ((hi < 0) & (lo / 2 >= hi))
    share = F.when(near, F.try_divide(v - lo, hi - lo)).otherwise(
        F.try_divide(_scaled(v) - _scaled(lo), _scaled(hi) - _scaled(lo)))
    inside = F.when(lo == hi, F.lit(0)).otherwise(F.least(F.floor(share * buckets), F.lit(buckets - 1)))
    return F.when(F.isnan(v), F.lit(buckets + 1)).when(v == inf, F.lit(buckets)).when(v == -inf, F.lit(-1)) \
        .otherwise(inside).cast("int")


def exact_quantiles(df: DataFrame, cols: list[str], shares: list[float], by: list[str] | None = None,
                    buckets: int = 4096, few: int = 20_000) -> DataFrame:
    """Quantiles of ``cols`` within each group: one row ``by..., column_name, n, q`` (array, one value a share).

    Between two ranks the value is interpolated linearly. Nulls do not count,
    NaN is the greatest value; a column without values has no row. Null groups
    are groups. ``df`` is read once for the ranges, once for the counts and
    once for the target buckets, more often only where a bucket of a very
    uneven column must be cut again.
    """
    by = by or []
    group = [f"_g{i}" for i in range(len(by))]
    key = [*group, "_c"]
    long = df.select(*[F.col(b).alias(g) for b, g in zip(by, group)], F.posexplode(F.array(
        *[F.col(c).cast("double") for c in cols])).alias("_c", "_v")).where(F.col("_v").isNotNull())
    v = F.col("_v")
    finite = F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)
    total = cut_lineage(long.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_lo"),
                                               F.max(finite).alias("_hi")))
    place = (F.col("_n") - 1) * F.col("_share")
    ends = F.array(F.struct(F.lit(0).alias("_side"), F.floor(place).alias("_k")),
                   F.struct(F.lit(1).alias("_side"), F.ceil(place).alias("_k")))
    span = ["_below", "_lo", "_hi"]
    targets = total.select("*", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("_i", "_share")) \
        .select("*", F.explode(ends).alias("_t")) \
        .select(*key, "_i", "_t._side", (F.col("_t._k") + 1).alias("_rank"), F.lit(0).cast("long").alias("_below"),
                "_lo", "_hi", "_n")
    targets, found, whole = cut_lineage(targets), [], True
    while targets.take(1):
        near = _within(long, targets.select(*key, *span), key, not whole)
        counts = near.withColumn("_b", _bucket(v, F.col("_lo"), F.col("_hi"), buckets)) \
            .groupBy(*key, "_below", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        so_far = F.sum("_n").over(Window.partitionBy(*key, "_below").orderBy("_b"))     # at most ``buckets`` + 3 rows
        counts = cut_lineage(counts.withColumn("_to", F.col("_below") + so_far))
        t = _renamed(targets.select(*key, "_i", "_side", "_rank", "_below"))
        first = F.col("_to") - F.col("_n")
        hit = counts.join(t, _same([*key, "_below"]) & (F.col("t_rank") > first) & (F.col("t_rank") <= F.col("_to")))
        new = cut_lineage(hit.select(*key, F.col("t_i").alias("_i"), F.col("t_side").alias("_side"),
                                     F.col("t_rank").alias("_rank"), first.alias("_below"), "_lo", "_hi", "_n"))
        same = F.col("_lo") == F.col("_hi")
        found.append(new.where(same).select(*key, "_i", "_side", F.col("_lo").alias("_x")))
        short = new.where(~same & (F.col("_n") <= few))
        if short.take(1):
            near = _within(long, short.select(*key, *span), key, True).select(*key, "_below", "_v")
            nth = near.withColumn("_rank", F.col("_below") + F.row_number().over(
                Window.partitionBy(*key, "_below").orderBy("_v")))
            t = _small(_renamed(short.select(*key, "_i", "_side", "_rank", "_below")))
            found.append(nth.join(t, _same([*key, "_below", "_rank"])).select(
                *key, F.col("t_i").alias("_i"), F.col("t_side").alias("_side"), F.col("_v").alias("_x")))
        targets, whole = cut_lineage(new.where(~same & (F.col("_n") > few))), False
    if not found:
        found = [targets.select(*key, "_i", "_side", F.col("_lo").alias("_x"))]
    marks = [(i, side) for i in range(len(shares)) for side in (0, 1)]
    picked = reduce(DataFrame.unionByName, found).groupBy(*key).agg(*[
        F.max(F.when((F.col("_i") == i) & (F.col("_side") == side), F.col("_x"))).alias(f"_{i}_{side}")
        for i, side in marks])
    out = picked.join(_renamed(total.select(*key, "_n")), _same(key)).withColumnRenamed("t_n", "_n")
    q = []
    for i, s in enumerate(shares):
        at, low, high = (F.col("_n") - 1) * F.lit(float(s)), F.col(f"_{i}_0"), F.col(f"_{i}_1")
        q.append(F.when((F.floor(at) == at) | (low == high), low)
                 .otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    names = F.array(*[F.lit(c) for c in cols])
    return cut_lineage(out.select(*[F.col(g).alias(b) for g, b in zip(group, by)],
                                  F.element_at(names, F.col("_c") + 1).alias("column_name"),
                                  F.col("_n").alias("n"), F.array(*q).alias("q")))


def _renamed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias("t" + c) for c in df.columns])


def _same(names: list[str]) -> Column:
    """Equality with the renamed side."""
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col("t" + k)) for k in names])


def _within(long: DataFrame, spans: DataFrame, key: list[str], cut: bool) -> DataFrame:
    """Values with the span of their group and column; if ``cut``, only those that lie in one."""
    s = _small(cut_lineage(_renamed(spans.distinct())))
    on = _same(key) & F.col("_v").between(F.col("t_lo"), F.col("t_hi")) if cut else _same(key)
    return long.join(s, on).select(*key, "_v", *[F.col("t" + c).alias(c) for c in ("_below", "_lo", "_hi")])
