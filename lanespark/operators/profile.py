"""Data profiling: describe, missing values, frequencies, correlations, distribution.

Wide statistics are computed in ONE aggregation over the table and unpivoted
afterwards (``stack``), so the scan happens once however many columns are
profiled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..functions.traffic import corr_direction, corr_strength
from ..session import cut_lineage
from .ordering import global_row_number
from .quantiles import exact_quantiles


def _stack(df: DataFrame, names: list[str], fields: list[str], key: str = "column_name") -> DataFrame:
    """Turn a 1-row frame with columns ``{name}__{field}`` into one row per name."""
    structs = [F.struct(F.lit(n).alias(key), *[F.col(f"{n}__{f}").alias(f) for f in fields]) for n in names]
    return df.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")


QUARTILES = [0.25, 0.5, 0.75]


def describe_numeric(df: DataFrame, cols: list[str], digits: int = 2, exact: bool = True) -> DataFrame:
    """AG-14: count, mean, std, min, q1, median, q3, max per column.

    ``exact`` takes the quartiles (linear interpolation) by rank selection, two
    further scans of these columns; False takes the bounded ``percentile_approx``
    sketch in the one scan of the other statistics.
    """
    if exact:
        df = cut_lineage(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
        if not exact:
            aggs.append(F.percentile_approx(x, F.array(*map(F.lit, QUARTILES)), 10000).alias(f"{c}__q"))
    stats = _stack(df.agg(*aggs), cols, ["count", "mean", "std", "min", "max"] + ([] if exact else ["q"]))
    if exact:
        found = exact_quantiles(df, cols, QUARTILES).select(F.col("column_name").alias("_name"), "q")
        stats = stats.join(found, F.col("column_name") == F.col("_name"), "left")   # one row for each column
    return stats.select("column_name", "count", *[rnd(x, digits).alias(x) for x in ("mean", "std", "min")],
                        *[rnd(F.col("q")[i], digits).alias(f"q{p}") for i, p in enumerate((25, 50, 75))],
                        rnd("max", digits).alias("max"))


def missing_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """AG-15: NULL count and percentage per column (NaN counts as missing)."""
    cols = cols or df.columns
    dtypes = dict(df.dtypes)

    def missing(c):
        cond = F.col(c).isNull()
        if dtypes[c] in ("double", "float"):
            cond = cond | F.isnan(c)
        return F.count_if(cond)

    one = df.agg(F.count(F.lit(1)).alias("_n"), *[missing(c).alias(f"{c}__missing") for c in cols])
    proj = [F.col("_n")]
    for c in cols:
        proj += [F.col(f"{c}__missing"),
                 rnd(F.try_divide(F.col(f"{c}__missing") * F.lit(100.0), F.col("_n")), 4).alias(f"{c}__pct")]
    return _stack(one.select(*proj), cols, ["missing", "pct"])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """AG-16: frequency and share of each non-null value."""
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = g.agg(F.sum("count").alias("_t"))  # one row
    return g.crossJoin(F.broadcast(total)).select(
        col, "count", rnd(F.col("count") * F.lit(100.0) / F.col("_t"), 4).alias("pct"))


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """AG-17: distinct non-null values per column."""
    fn = (lambda c: F.approx_count_distinct(c, 0.01)) if approx else F.count_distinct
    one = df.agg(*[fn(c).alias(f"{c}__n_distinct") for c in cols])
    return _stack(one, cols, ["n_distinct"])


def correlation_matrix(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """AG-18: Pearson r for every pair (both orders and the diagonal), one aggregation."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    structs = []
    for a, b in pairs:
        r = rnd(F.col(f"{a}__{b}"), digits)
        structs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("r")))
        structs.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), r.alias("r")))
    for c in cols:
        structs.append(F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.lit(1.0).alias("r")))
    return one.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")


def target_correlation(df: DataFrame, cols: list[str], target: str, top: int = 4) -> DataFrame:
    """AG-19 + PRJ-19: correlation with the target, strength/direction labels, top-k by |r|."""
    others = [c for c in cols if c != target]
    one = df.agg(*[F.corr(c, target).alias(c) for c in others])
    long = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("_r")) for c in others])).alias("_s")).select("_s.*")
    # ranking a handful of rows (one per column): tiny window
    from pyspark.sql import Window
    w = Window.orderBy(F.desc(F.abs("_r")), "feature")
    return long.select("feature", rnd("_r", 6).alias("r"), corr_strength("_r").alias("strength"),
                       corr_direction("_r").alias("direction"),
                       (F.row_number().over(w) <= top).alias("is_top"))


def histogram(df: DataFrame, col: str, bins: int = 50, digits: int = 4) -> DataFrame:
    """AG-20: equal-width bins over [min, max], last bin closed (empty bins omitted)."""
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))  # one row: broadcast scalar
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(w == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("_lo")) / w), F.lit(bins - 1))).cast("int")
    j = df.where(x.isNotNull()).crossJoin(F.broadcast(rng)).withColumn("bin", b)
    g = j.groupBy("bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
    return g.select("bin", rnd(F.col("_lo") + F.col("bin") * w, digits).alias("bin_low"),
                    rnd(F.col("_lo") + (F.col("bin") + 1) * w, digits).alias("bin_high"), "count")


def iqr_outliers(df: DataFrame, col: str, digits: int = 4) -> DataFrame:
    """AG-21: quartiles by rank selection, IQR, 1.5·IQR fences, whiskers and outlier count."""
    x = F.col(col).cast("double")
    df = cut_lineage(df.select(col))
    q = exact_quantiles(df, [col], QUARTILES).select(*[F.col("q")[i].alias(f"_q{i + 1}") for i in range(3)])
    lo = F.col("_q1") - F.lit(1.5) * (F.col("_q3") - F.col("_q1"))
    hi = F.col("_q3") + F.lit(1.5) * (F.col("_q3") - F.col("_q1"))
    j = df.where(x.isNotNull()).select(x.alias("_x")).crossJoin(F.broadcast(q))
    g = j.groupBy("_q1", "_q2", "_q3").agg(
        F.min(F.when(F.col("_x") >= lo, F.col("_x"))).alias("_wl"),
        F.max(F.when(F.col("_x") <= hi, F.col("_x"))).alias("_wh"),
        F.count_if((F.col("_x") < lo) | (F.col("_x") > hi)).alias("n_outliers"))
    return g.select(rnd("_q1", digits).alias("q1"), rnd("_q2", digits).alias("median"),
                    rnd("_q3", digits).alias("q3"), rnd(F.col("_q3") - F.col("_q1"), digits).alias("iqr"),
                    rnd(lo, digits).alias("lower_fence"), rnd(hi, digits).alias("upper_fence"),
                    rnd("_wl", digits).alias("whisker_low"), rnd("_wh", digits).alias("whisker_high"),
                    "n_outliers")


def ecdf(df: DataFrame, col: str, digits: int = 8) -> DataFrame:
    """AG-22: sorted values against evenly spaced positions i/(n-1) (numpy linspace).

    Numbering is distributed (range partitioning on value plus a row hash as
    tiebreak, so one very frequent value still spreads over many tasks).
    """
    x = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("value"),
                                                F.xxhash64(*[F.col(c) for c in df.columns]).alias("_tb"))
    numbered = global_row_number(x, ["value", "_tb"], "_rn", total="_n")
    pos = F.when(F.col("_n") == 1, F.lit(0.0)).otherwise((F.col("_rn") - 1) / (F.col("_n") - 1))
    return numbered.select("value", rnd(pos, digits).alias("position"))


def clean_numeric(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """PRJ-01: coerce columns to double, drop rows where any is missing or no number.

    Returns (clean rows, report). A row counts against the FIRST column that
    is missing or fails, as in sequential per-column dropping; NaN is missing.
    """
    casted = df.select("*", *[F.col(c).cast("string").try_cast("double").alias(f"__n_{c}") for c in cols])
    ok = [F.col(f"__n_{c}").isNotNull() & ~F.isnan(f"__n_{c}") for c in cols]
    bad = [~e for e in ok]
    counters = []
    for i, c in enumerate(cols):
        cond = bad[i]
        for j in range(i):
            cond = cond & ok[j]
        counters.append(F.count_if(cond).alias(c))
    report = casted.agg(*counters)
    report = report.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("rows_removed")) for c in cols])).alias("_s")) \
        .select("_s.*")
    all_ok = ok[0]
    for e in ok[1:]:
        all_ok = all_ok & e
    clean = casted.where(all_ok).select(*[F.col(f"__n_{c}").alias(c) if c in cols else F.col(c)
                                          for c in df.columns])
    return clean, report
