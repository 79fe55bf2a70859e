"""Time / area / weather analytics over a daily table (one row per date and road).

Every operator is ``daily -> DataFrame``; group keys drop NULLs like pandas
``groupby`` does. Statistics are rounded half-up at the edge (``rnd``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..session import cut_lineage
from .quantiles import exact_quantiles

DATE, TARGET, AREA, ROAD, WEATHER, ROADWORK = (
    "traffic_date", "volume", "area_name", "road_name", "weather", "roadwork")

# ---- fixed values that must equal the reference's ---------------------------
DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
SIGNIFICANT_CHANGE_PCT = 10.0      # annotated month-over-month changes
REPORTED_CHANGE_PCT = 8.0          # changes explained in the findings report
DECREASE_REASONS = [               # (months, reason) checked in this order
    ([6, 7, 8, 9], "Monsoon season - heavy rainfall reduces travel"),
    ([1], "New Year period - reduced commuter traffic"),
    ([4, 5], "Summer holidays - schools/colleges closed, reduced commute"),
    ([12], "Year-end holidays and reduced business activity"),
]
DECREASE_GENERIC = ["Possible increase in remote work during this period",
                    "Construction/road closures may have diverted traffic"]
INCREASE_REASONS = [
    ([1, 2], "Post-holiday return to normal traffic patterns"),
    ([9, 10], "End of monsoon - roads clear, festivals begin (Dasara, Diwali)"),
    ([3, 4], "Financial year-end - increased business activity"),
    ([10, 11], "Festival season (Dasara, Diwali) increases shopping/travel"),
]
INCREASE_GENERIC = ["Normal seasonal recovery in commuter patterns"]
# -----------------------------------------------------------------------------


def _nn(df: DataFrame, *cols) -> DataFrame:
    cond = None
    for c in cols:
        e = F.col(c).isNotNull()
        cond = e if cond is None else cond & e
    return df.where(cond)


def _stats(target, digits=4, count=True, std=True):
    out = [rnd(F.avg(target), digits).alias("mean")]
    if std:
        out.append(rnd(F.stddev_samp(target), digits).alias("std"))
    if count:
        out.append(F.count(target).alias("count"))
    return out


def monthly_stats(daily: DataFrame, target: str = TARGET) -> DataFrame:
    """AG-02: mean/std/count per month plus the mean±std band."""
    g = _nn(daily, DATE).groupBy(F.trunc(DATE, "month").alias("year_month")).agg(
        F.avg(target).alias("_m"), F.stddev_samp(target).alias("_s"), F.count(target).alias("count"))
    return g.select("year_month", rnd("_m", 4).alias("mean"), rnd("_s", 4).alias("std"), "count",
                    rnd(F.col("_m") - F.col("_s"), 4).alias("band_low"),
                    rnd(F.col("_m") + F.col("_s"), 4).alias("band_high"))


def month_over_month(daily: DataFrame, target: str = TARGET) -> DataFrame:
    """WN-05: change vs the previous *present* month (window over the small monthly frame)."""
    m = _nn(daily, DATE).groupBy(F.trunc(DATE, "month").alias("year_month")).agg(F.avg(target).alias("_m"))
    w = Window.orderBy("year_month")  # one row per month: tiny
    prev = F.lag("_m").over(w)
    return m.select(
        "year_month", rnd("_m", 4).alias("mean"),
        rnd(F.col("_m") - prev, 4).alias("abs_change"),
        rnd(F.try_divide(F.col("_m") - prev, prev) * F.lit(100.0), 4).alias("pct_change"))


def significant_change(daily: DataFrame, target: str = TARGET, threshold: float = SIGNIFICANT_CHANGE_PCT):
    """FLT-04: months whose |pct change| exceeds the threshold."""
    return month_over_month(daily, target).where(F.abs("pct_change") > threshold) \
        .withColumn("direction", F.when(F.col("pct_change") < 0, "down").otherwise("up"))


def fluctuation_reasons(daily: DataFrame, target: str = TARGET, threshold: float = REPORTED_CHANGE_PCT):
    """PRJ-26: up to three reasons for every month whose |change| exceeds the threshold."""
    m = month_over_month(daily, target).where(F.abs("pct_change") > threshold)
    mon = F.month("year_month")

    def reasons(rules, generic):
        items = [F.when(mon.isin(months), F.lit(text)) for months, text in rules]
        items += [F.lit(t) for t in generic]
        return F.slice(F.array_compact(F.array(*items)), 1, 3)

    down = F.col("pct_change") < 0
    return m.select(
        "year_month", "pct_change",
        F.when(down, "DECREASED").otherwise("INCREASED").alias("direction"),
        F.array_join(F.when(down, reasons(DECREASE_REASONS, DECREASE_GENERIC))
                     .otherwise(reasons(INCREASE_REASONS, INCREASE_GENERIC)), "; ").alias("reasons"))


def month_by_year(daily: DataFrame, target: str = TARGET) -> DataFrame:
    """AG-03."""
    return _nn(daily, DATE).groupBy(F.year(DATE).alias("year"), F.month(DATE).alias("month")) \
        .agg(rnd(F.avg(target), 4).alias("mean"))


def yearly_avg(daily: DataFrame, target: str = TARGET) -> DataFrame:
    """AG-04."""
    return _nn(daily, DATE).groupBy(F.year(DATE).alias("year")).agg(rnd(F.avg(target), 4).alias("mean"))


def day_of_week(daily: DataFrame, target: str = TARGET) -> DataFrame:
    """AG-05: Monday-first, all seven days kept (NULL stats for absent days)."""
    spark = daily.sparkSession
    days = spark.range(7).select(F.col("id").cast("int").alias("day_index"),
                                 F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")),
                                               "EEEE").alias("day_name"))
    stats = _nn(daily, DATE).groupBy(F.weekday(DATE).alias("day_index")) \
        .agg(*_stats(target, count=False))
    return F.broadcast(days).join(stats, "day_index", "left")


def weekday_weekend_gap(daily: DataFrame, target: str = TARGET) -> DataFrame:
    """AG-06 / FLT-08: conditional means in one pass."""
    we = F.weekday(DATE) >= 5
    g = daily.agg(F.avg(F.when(~we, F.col(target))).alias("_wd"), F.avg(F.when(we, F.col(target))).alias("_we"))
    return g.select(rnd("_wd", 4).alias("weekday_avg"), rnd("_we", 4).alias("weekend_avg"),
                    rnd(F.try_divide(F.col("_wd") - F.col("_we"), F.col("_we")) * F.lit(100.0), 4).alias("diff_pct"))


def quarterly(daily: DataFrame, target: str = TARGET) -> DataFrame:
    """AG-07."""
    return _nn(daily, DATE).groupBy(F.year(DATE).alias("year"), F.quarter(DATE).alias("quarter")) \
        .agg(rnd(F.avg(target), 4).alias("mean"))


def group_stats(daily: DataFrame, key: str, target: str = TARGET) -> DataFrame:
    """AG-08/09/13: mean/std/count per category."""
    return _nn(daily, key).groupBy(key).agg(*_stats(target))


def weather_distribution(daily: DataFrame, target: str = TARGET) -> DataFrame:
    """AG-10: quartiles and box-plot whiskers per weather category (exact, by rank selection)."""
    base = cut_lineage(_nn(daily, WEATHER).select(WEATHER, F.col(target).alias("_x")).where(F.col("_x").isNotNull()))
    q = exact_quantiles(base, ["_x"], [0.25, 0.5, 0.75], [WEATHER])
    q = q.select(WEATHER, F.col("q")[0].alias("_q1"), F.col("q")[1].alias("_q2"), F.col("q")[2].alias("_q3"))
    iqr = F.col("_q3") - F.col("_q1")
    j = base.join(q, WEATHER)  # q has one row per category
    lo_f, hi_f = F.col("_q1") - F.lit(1.5) * iqr, F.col("_q3") + F.lit(1.5) * iqr
    w = j.groupBy(WEATHER, "_q1", "_q2", "_q3").agg(
        F.min(F.when(F.col("_x") >= lo_f, F.col("_x"))).alias("_wl"),
        F.max(F.when(F.col("_x") <= hi_f, F.col("_x"))).alias("_wh"))
    return w.select(WEATHER, rnd("_q1", 4).alias("q1"), rnd("_q2", 4).alias("median"), rnd("_q3", 4).alias("q3"),
                    rnd(F.col("_q3") - F.col("_q1"), 4).alias("iqr"),
                    rnd("_wl", 4).alias("whisker_low"), rnd("_wh", 4).alias("whisker_high"))


def area_month_pivot(daily: DataFrame, target: str = TARGET) -> DataFrame:
    """AG-11: area x month mean matrix (months fixed 1..12 -> no extra distinct job)."""
    p = _nn(daily, AREA, DATE).withColumn("_mon", F.month(DATE)) \
        .groupBy(AREA).pivot("_mon", list(range(1, 13))).agg(rnd(F.avg(target), 4))
    return p.select(AREA, *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)])


def daily_mean(daily: DataFrame, target: str = TARGET) -> DataFrame:
    """AG-12."""
    return _nn(daily, DATE).groupBy(DATE).agg(rnd(F.avg(target), 4).alias("mean"))


def centered_ma30(daily: DataFrame, target: str = TARGET) -> DataFrame:
    """WN-06: centred 30-row moving average of the per-date mean (NULL unless 30 rows).

    Runs on the per-date frame (one row per calendar day: small), rows -15..+14.
    """
    d = _nn(daily, DATE).groupBy(DATE).agg(F.avg(target).alias("_m"))
    w = Window.orderBy(DATE).rowsBetween(-15, 14)
    return d.select(DATE, rnd("_m", 4).alias("mean"),
                    F.when(F.count("_m").over(w) == 30, rnd(F.avg("_m").over(w), 4)).alias("ma_30"))


def topk_areas(daily: DataFrame, k: int = 3, target: str = TARGET) -> DataFrame:
    """SL-04: the k areas with the highest mean."""
    g = _nn(daily, AREA).groupBy(AREA).agg(F.avg(target).alias("_m"))
    return g.orderBy(F.desc("_m"), AREA).limit(k).select(AREA, rnd("_m", 4).alias("mean"))


def season_findings(daily: DataFrame, target: str = TARGET) -> DataFrame:
    """PRJ-29: the three flags of the weather / weekday findings."""
    wmeans = _nn(daily, WEATHER).groupBy(WEATHER).agg(F.avg(target).alias("_m"))
    summary = wmeans.agg(
        F.max("_m").alias("_max"),
        F.max(F.when(F.col(WEATHER) == "Rain", F.col("_m"))).alias("_rain"),
        F.min_by(WEATHER, F.struct("_m", WEATHER)).alias("_first"),
        F.max_by(WEATHER, F.struct("_m", WEATHER)).alias("_top"))
    gap = weekday_weekend_gap(daily, target)
    rain_ref = F.coalesce(F.col("_rain"), F.col("_first_mean"))
    first_mean = wmeans.agg(F.min_by("_m", F.struct("_m", WEATHER)).alias("_first_mean"))
    j = summary.crossJoin(first_mean).crossJoin(gap)  # 1-row frames
    return j.select(
        F.when(rain_ref < F.col("_max"), "reduce").otherwise("increase").alias("rain_effect"),
        F.when(F.col("_top") == "Clear", "highest").otherwise("moderate").alias("clear_level"),
        F.when(F.col("diff_pct") > 0, "higher").otherwise("lower").alias("weekday_vs_weekend"),
        F.col("_top").alias("top_weather"))
