"""Analytics queries over the historical daily table (binding ``daily_traffic``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd, sql_rnd as R
from ..operators import calendar as C
from ..operators import profile as P
from ..operators import temporal as T
from ..operators.split import SQL_DAILY_KEY, sql_arith_hash
from ..sources import bindings as B
from .registry import register


def dt(spark, sf):
    return B.daily_traffic(spark, sf)


def W(sql: str) -> str:
    return B.with_bindings(sql, "daily_traffic")


def WX(text: str) -> str:
    """Oracle whose text starts with further CTEs (``name AS (...), ... SELECT``)."""
    return "WITH " + B.ORACLE_CTE["daily_traffic"].strip() + ",\n" + text.strip()


NUMERIC = ["volume", "avg_speed", "tti", "congestion", "capacity_util", "incidents"]
MONTH = "CAST(date_trunc('month', traffic_date) AS DATE)"
WEEKDAY = "CAST(isodow(traffic_date) - 1 AS INT)"


@register("scan_daily", W("SELECT * FROM daily_traffic"))
def q_scan_daily(spark, sf):
    """SRC-01: the historical daily table with explicit types."""
    return dt(spark, sf)


@register("scan_daily_csv", W("""
SELECT traffic_date, road_name, area_name, volume, avg_speed, tti, congestion, capacity_util, incidents, weather, roadwork
FROM daily_traffic"""))
def q_scan_daily_csv(spark, sf):
    """SRC-01 + SRC-02: the daily table as a historical CSV (published header, extra columns empty), scanned with an
    explicit schema and checked for the required columns."""
    from ..sources import sinks as K
    from ..streaming.jobs import scratch
    ours = {v: k for k, v in K.DAILY_CSV_NAMES.items()}
    d = dt(spark, sf)
    kinds = {f.name: f.dataType for f in K.DAILY_CSV_SCHEMA}
    out = d.select(*[(F.col(K.DAILY_CSV_NAMES[n]) if K.DAILY_CSV_NAMES[n] in d.columns else F.lit(None))
                     .cast(kinds[n]).alias(n) for n in kinds])
    path = scratch(spark, "historical")
    out.write.option("header", True).csv(path)
    back = K.scan_daily_csv(spark, path)
    return back.select(*[c for c in ours if c in d.columns])


@register("monthly_stats", W(f"""
SELECT {MONTH} AS year_month, {R('avg(volume)', 4)} AS mean, {R('stddev_samp(volume)', 4)} AS std,
       count(volume) AS count,
       {R('avg(volume) - stddev_samp(volume)', 4)} AS band_low, {R('avg(volume) + stddev_samp(volume)', 4)} AS band_high
FROM daily_traffic WHERE traffic_date IS NOT NULL GROUP BY 1"""), headline=True)
def q_monthly_stats(spark, sf):
    return T.monthly_stats(dt(spark, sf))


_MOM = f"""m AS (SELECT {MONTH} AS year_month, avg(volume) AS m FROM daily_traffic
        WHERE traffic_date IS NOT NULL GROUP BY 1),
mm AS (SELECT year_month, m, lag(m) OVER (ORDER BY year_month) AS p FROM m),
mom AS (SELECT year_month, {R('m', 4)} AS mean, {R('m - p', 4)} AS abs_change,
               {R('(m - p) / nullif(p, 0) * 100.0e0', 4)} AS pct_change FROM mm)"""


def WM(sql: str) -> str:
    return WX(_MOM + "\n" + sql)


@register("month_over_month", WM("SELECT * FROM mom"))
def q_month_over_month(spark, sf):
    return T.month_over_month(dt(spark, sf))


@register("significant_change", WM("""
SELECT *, CASE WHEN pct_change < 0 THEN 'down' ELSE 'up' END AS direction
FROM mom WHERE abs(pct_change) > 10"""))
def q_significant_change(spark, sf):
    """FLT-04."""
    return T.significant_change(dt(spark, sf))


def _reasons_sql():
    def arr(rules, generic):
        items = [f"CASE WHEN month(year_month) IN ({', '.join(map(str, m))}) THEN '{t}' END" for m, t in rules]
        items += [f"'{g}'" for g in generic]
        return f"array_to_string(list_slice(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), 1, 3), '; ')"
    return arr(T.DECREASE_REASONS, T.DECREASE_GENERIC), arr(T.INCREASE_REASONS, T.INCREASE_GENERIC)


_DOWN, _UP = _reasons_sql()


@register("fluctuation_reasons", WM(f"""
SELECT year_month, pct_change,
       CASE WHEN pct_change < 0 THEN 'DECREASED' ELSE 'INCREASED' END AS direction,
       CASE WHEN pct_change < 0 THEN {_DOWN} ELSE {_UP} END AS reasons
FROM mom WHERE abs(pct_change) > 8"""))
def q_fluctuation_reasons(spark, sf):
    """PRJ-26."""
    return T.fluctuation_reasons(dt(spark, sf))


@register("month_by_year", W(f"""
SELECT CAST(year(traffic_date) AS INT) AS year, CAST(month(traffic_date) AS INT) AS month,
       {R('avg(volume)', 4)} AS mean
FROM daily_traffic WHERE traffic_date IS NOT NULL GROUP BY 1, 2"""))
def q_month_by_year(spark, sf):
    return T.month_by_year(dt(spark, sf))


@register("yearly_avg", W(f"""
SELECT CAST(year(traffic_date) AS INT) AS year, {R('avg(volume)', 4)} AS mean
FROM daily_traffic WHERE traffic_date IS NOT NULL GROUP BY 1"""))
def q_yearly_avg(spark, sf):
    return T.yearly_avg(dt(spark, sf))


@register("day_of_week", W(f"""
SELECT d.day_index, d.day_name, s.mean, s.std
FROM (SELECT CAST(i AS INT) AS day_index, dayname(DATE '2024-01-01' + CAST(i AS INT)) AS day_name
      FROM range(7) t(i)) d
LEFT JOIN (SELECT {WEEKDAY} AS day_index, {R('avg(volume)', 4)} AS mean, {R('stddev_samp(volume)', 4)} AS std
           FROM daily_traffic WHERE traffic_date IS NOT NULL GROUP BY 1) s ON s.day_index = d.day_index"""))
def q_day_of_week(spark, sf):
    """AG-05."""
    return T.day_of_week(dt(spark, sf))


_GAP_SQL = f"""
SELECT {R('avg(volume) FILTER (WHERE isodow(traffic_date) < 6)', 4)} AS weekday_avg,
       {R('avg(volume) FILTER (WHERE isodow(traffic_date) >= 6)', 4)} AS weekend_avg,
       {R('''(avg(volume) FILTER (WHERE isodow(traffic_date) < 6) - avg(volume) FILTER (WHERE isodow(traffic_date) >= 6))
          / nullif(avg(volume) FILTER (WHERE isodow(traffic_date) >= 6), 0) * 100.0e0''', 4)} AS diff_pct
FROM daily_traffic"""


@register("weekday_weekend_gap", W(_GAP_SQL))
def q_weekday_weekend_gap(spark, sf):
    """AG-06."""
    return T.weekday_weekend_gap(dt(spark, sf))


@register("weekday_weekend_split", W(f"""
SELECT CAST(isodow(traffic_date) >= 6 AS INT) AS is_weekend, count(*) AS n, {R('avg(volume)', 4)} AS mean
FROM daily_traffic WHERE traffic_date IS NOT NULL GROUP BY 1"""))
def q_weekday_weekend_split(spark, sf):
    """FLT-08: the boolean split as one grouped pass."""
    d = dt(spark, sf).where(F.col("traffic_date").isNotNull())
    return d.groupBy((F.weekday("traffic_date") >= 5).cast("int").alias("is_weekend")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("volume"), 4).alias("mean"))


@register("quarterly", W(f"""
SELECT CAST(year(traffic_date) AS INT) AS year, CAST(quarter(traffic_date) AS INT) AS quarter,
       {R('avg(volume)', 4)} AS mean
FROM daily_traffic WHERE traffic_date IS NOT NULL GROUP BY 1, 2"""))
def q_quarterly(spark, sf):
    return T.quarterly(dt(spark, sf))


def _group_stats_sql(key):
    return W(f"""
SELECT {key}, {R('avg(volume)', 4)} AS mean, {R('stddev_samp(volume)', 4)} AS std, count(volume) AS count
FROM daily_traffic WHERE {key} IS NOT NULL GROUP BY 1""")


@register("area_stats", _group_stats_sql("area_name"))
def q_area_stats(spark, sf):
    """AG-08."""
    return T.group_stats(dt(spark, sf), "area_name")


@register("weather_stats", _group_stats_sql("weather"))
def q_weather_stats(spark, sf):
    """AG-09."""
    return T.group_stats(dt(spark, sf), "weather")


@register("roadwork_impact", _group_stats_sql("roadwork"))
def q_roadwork_impact(spark, sf):
    """AG-13."""
    return T.group_stats(dt(spark, sf), "roadwork")


@register("weather_distribution", WX(f"""
q AS (SELECT weather, quantile_cont(volume, 0.25) AS q1, quantile_cont(volume, 0.5) AS q2,
             quantile_cont(volume, 0.75) AS q3
      FROM daily_traffic WHERE weather IS NOT NULL AND volume IS NOT NULL GROUP BY 1)
SELECT q.weather, {R('q1', 4)} AS q1, {R('q2', 4)} AS median, {R('q3', 4)} AS q3, {R('q3 - q1', 4)} AS iqr,
       {R('min(volume) FILTER (WHERE volume >= q1 - 1.5e0 * (q3 - q1))', 4)} AS whisker_low,
       {R('max(volume) FILTER (WHERE volume <= q3 + 1.5e0 * (q3 - q1))', 4)} AS whisker_high
FROM daily_traffic d JOIN q ON d.weather = q.weather WHERE volume IS NOT NULL
GROUP BY q.weather, q1, q2, q3"""))
def q_weather_distribution(spark, sf):
    """AG-10."""
    return T.weather_distribution(dt(spark, sf))


@register("area_month_pivot", W("SELECT area_name, " + ", ".join(
    f"{R(f'avg(volume) FILTER (WHERE month(traffic_date) = {m})', 4)} AS m{m:02d}" for m in range(1, 13))
    + " FROM daily_traffic WHERE area_name IS NOT NULL AND traffic_date IS NOT NULL GROUP BY 1"))
def q_area_month_pivot(spark, sf):
    """AG-11."""
    return T.area_month_pivot(dt(spark, sf))


@register("daily_mean", W(f"""
SELECT traffic_date, {R('avg(volume)', 4)} AS mean FROM daily_traffic
WHERE traffic_date IS NOT NULL GROUP BY 1"""))
def q_daily_mean(spark, sf):
    """AG-12."""
    return T.daily_mean(dt(spark, sf))


@register("centered_ma30", W(f"""
SELECT traffic_date, {R('m', 4)} AS mean,
       CASE WHEN count(m) OVER w = 30 THEN {R('avg(m) OVER w', 4)} END AS ma_30
FROM (SELECT traffic_date, avg(volume) AS m FROM daily_traffic WHERE traffic_date IS NOT NULL GROUP BY 1)
WINDOW w AS (ORDER BY traffic_date ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)"""))
def q_centered_ma30(spark, sf):
    """WN-06."""
    return T.centered_ma30(dt(spark, sf))


@register("topk_areas", W(f"""
SELECT area_name, {R('avg(volume)', 4)} AS mean FROM daily_traffic WHERE area_name IS NOT NULL
GROUP BY 1 ORDER BY avg(volume) DESC, area_name LIMIT 3"""))
def q_topk_areas(spark, sf):
    """SL-04."""
    return T.topk_areas(dt(spark, sf))


@register("season_findings", WX(f"""
wm AS (SELECT weather, avg(volume) AS m FROM daily_traffic WHERE weather IS NOT NULL GROUP BY 1),
s AS (SELECT max(m) AS mx, max(m) FILTER (WHERE weather = 'Rain') AS rain,
             arg_min(m, (m, weather)) AS first_mean, arg_max(weather, (m, weather)) AS top FROM wm),
g AS ({_GAP_SQL})
SELECT CASE WHEN coalesce(rain, first_mean) < mx THEN 'reduce' ELSE 'increase' END AS rain_effect,
       CASE WHEN top = 'Clear' THEN 'highest' ELSE 'moderate' END AS clear_level,
       CASE WHEN diff_pct > 0 THEN 'higher' ELSE 'lower' END AS weekday_vs_weekend,
       top AS top_weather
FROM s, g"""))
def q_season_findings(spark, sf):
    """PRJ-29."""
    return T.season_findings(dt(spark, sf))


# ---- calendar projections ---------------------------------------------------

_CAL_SQL = f"""
SELECT traffic_date, road_name,
       CAST(year(traffic_date) AS INT) AS year, CAST(month(traffic_date) AS INT) AS month,
       CAST(day(traffic_date) AS INT) AS day, CAST(quarter(traffic_date) AS INT) AS quarter,
       CAST(dayofyear(traffic_date) AS INT) AS day_of_year, {WEEKDAY} AS day_of_week,
       CAST(weekofyear(traffic_date) AS INT) AS week_of_year
FROM daily_traffic"""


@register("calendar_features", W(_CAL_SQL))
def q_calendar_features(spark, sf):
    """PRJ-03."""
    return C.calendar_features(dt(spark, sf).select("traffic_date", "road_name"))


@register("day_name", W("SELECT traffic_date, road_name, dayname(traffic_date) AS day_name FROM daily_traffic"))
def q_day_name(spark, sf):
    """PRJ-04."""
    return dt(spark, sf).select("traffic_date", "road_name", C.day_name("traffic_date").alias("day_name"))


@register("is_weekend", W(f"SELECT traffic_date, road_name, CAST({WEEKDAY} >= 5 AS INT) AS is_weekend FROM daily_traffic"))
def q_is_weekend(spark, sf):
    """PRJ-05."""
    return dt(spark, sf).select("traffic_date", "road_name", C.is_weekend("traffic_date").alias("is_weekend"))


@register("cyclical_encoding", W(f"""
SELECT traffic_date, road_name,
       {R('sin(2 * pi() * month(traffic_date) / 12.0e0)', 8)} AS month_sin,
       {R('cos(2 * pi() * month(traffic_date) / 12.0e0)', 8)} AS month_cos,
       {R(f'sin(2 * pi() * ({WEEKDAY}) / 7.0e0)', 8)} AS dow_sin,
       {R(f'cos(2 * pi() * ({WEEKDAY}) / 7.0e0)', 8)} AS dow_cos,
       {R('sin(2 * pi() * quarter(traffic_date) / 4.0e0)', 8)} AS quarter_sin,
       {R('cos(2 * pi() * quarter(traffic_date) / 4.0e0)', 8)} AS quarter_cos
FROM daily_traffic"""))
def q_cyclical_encoding(spark, sf):
    """PRJ-06."""
    return C.cyclical_encoding(dt(spark, sf).select("traffic_date", "road_name"), digits=8)


@register("days_since_start", W("""
SELECT traffic_date, road_name, CAST(traffic_date - (SELECT min(traffic_date) FROM daily_traffic) AS INT) AS days_since_start
FROM daily_traffic"""))
def q_days_since_start(spark, sf):
    """PRJ-07 / JN-08: date minus the global minimum (1-row broadcast)."""
    return C.days_since_start(dt(spark, sf).select("traffic_date", "road_name"))


@register("year_progress", W(f"""
SELECT traffic_date, road_name, {R('dayofyear(traffic_date) / 365.0e0', 8)} AS year_progress FROM daily_traffic"""))
def q_year_progress(spark, sf):
    """PRJ-08."""
    return dt(spark, sf).select("traffic_date", "road_name", rnd(C.year_progress("traffic_date"), 8).alias("year_progress"))


@register("year_month", W(f"SELECT traffic_date, road_name, {MONTH} AS year_month FROM daily_traffic"))
def q_year_month(spark, sf):
    """PRJ-09."""
    return dt(spark, sf).select("traffic_date", "road_name", F.trunc("traffic_date", "month").alias("year_month"))


@register("parse_date", W("""
SELECT road_name, CAST(strftime(traffic_date, '%Y-%m-%d') AS VARCHAR) AS date_text,
       CAST(CAST(strftime(traffic_date, '%Y-%m-%d') AS VARCHAR) AS DATE) AS traffic_date FROM daily_traffic"""))
def q_parse_date(spark, sf):
    """PRJ-02: text -> DATE (try_to_date: bad text becomes NULL instead of failing)."""
    d = dt(spark, sf).select("road_name", F.date_format("traffic_date", "yyyy-MM-dd").alias("date_text"))
    return d.select("road_name", "date_text", C.parse_date("date_text").alias("traffic_date"))


@register("roadwork_flag", W("""
SELECT traffic_date, road_name, CAST(coalesce(roadwork = 'Yes', false) AS INT) AS roadwork_flag FROM daily_traffic"""))
def q_roadwork_flag(spark, sf):
    """PRJ-10."""
    from ..functions.traffic import yes_flag
    return dt(spark, sf).select("traffic_date", "road_name", yes_flag("roadwork").alias("roadwork_flag"))


@register("sort_daily", W("SELECT * FROM daily_traffic ORDER BY traffic_date, area_name, road_name"))
def q_sort_daily(spark, sf):
    """SL-01: final ordering at the edge only."""
    return dt(spark, sf).orderBy("traffic_date", "area_name", "road_name")


@register("preview", W("SELECT * FROM daily_traffic ORDER BY traffic_date, road_name LIMIT 100"))
def q_preview(spark, sf):
    """SL-06: head(100) over an explicit order (TakeOrderedAndProject, no full sort)."""
    return dt(spark, sf).orderBy("traffic_date", "road_name").limit(100)


# ---- profiling ----------------------------------------------------------------

def _describe_sql(cols, digits=2):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, count({x}) AS count, {R(f'avg({x})', digits)} AS mean,
  {R(f'stddev_samp({x})', digits)} AS std, {R(f'min({x})', digits)} AS min,
  {R(f'quantile_cont({x}, 0.25)', digits)} AS q25, {R(f'quantile_cont({x}, 0.5)', digits)} AS q50,
  {R(f'quantile_cont({x}, 0.75)', digits)} AS q75, {R(f'max({x})', digits)} AS max FROM daily_traffic""")
    return W("\nUNION ALL\n".join(parts))


@register("describe_numeric", _describe_sql(NUMERIC), headline=True)
def q_describe_numeric(spark, sf):
    """AG-14."""
    return P.describe_numeric(dt(spark, sf), NUMERIC)


_ALL_DT = ["traffic_date", "road_name", "area_name", "volume", "avg_speed", "tti", "congestion",
           "capacity_util", "incidents", "weather", "roadwork"]


@register("missing_profile", W("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL{' OR isnan(' + c + ')' if c in NUMERIC[:-1] else ''}) AS BIGINT) AS missing, "
    f"{R('count_if(' + c + ' IS NULL' + (' OR isnan(' + c + ')' if c in NUMERIC[:-1] else '') + ') * 100.0e0 / nullif(count(*), 0)', 4)} AS pct "
    "FROM daily_traffic" for c in _ALL_DT)))
def q_missing_profile(spark, sf):
    """AG-15."""
    return P.missing_profile(dt(spark, sf), _ALL_DT)


@register("value_counts", W(f"""
SELECT weather, count(*) AS count, {R('count(*) * 100.0e0 / sum(count(*)) OVER ()', 4)} AS pct
FROM daily_traffic WHERE weather IS NOT NULL GROUP BY 1"""))
def q_value_counts(spark, sf):
    """AG-16."""
    return P.value_counts(dt(spark, sf), "weather")


@register("distinct_counts", W("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM daily_traffic"
    for c in ["road_name", "area_name", "weather", "roadwork", "traffic_date"])))
def q_distinct_counts(spark, sf):
    """AG-17."""
    return P.distinct_counts(dt(spark, sf), ["road_name", "area_name", "weather", "roadwork", "traffic_date"])


def _corr_sql():
    from itertools import combinations
    parts = []
    for a, b in combinations(NUMERIC, 2):
        parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f'corr({a}, {b})', 6)} AS r FROM daily_traffic")
        parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {R(f'corr({a}, {b})', 6)} AS r FROM daily_traffic")
    for c in NUMERIC:
        parts.append(f"SELECT '{c}' AS col_a, '{c}' AS col_b, 1.0e0 AS r")
    return W("\nUNION ALL\n".join(parts))


@register("correlation_matrix", _corr_sql(), headline=True)
def q_correlation_matrix(spark, sf):
    """AG-18."""
    return P.correlation_matrix(dt(spark, sf), NUMERIC)


def _target_corr_sql():
    inner = "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, corr({c}, volume) AS r FROM daily_traffic"
                                 for c in NUMERIC if c != "volume")
    return W(f"""
SELECT feature, {R('r', 6)} AS r,
       CASE WHEN abs(r) > 0.7 THEN 'Strong' WHEN abs(r) > 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength,
       CASE WHEN r > 0 THEN 'Positive' ELSE 'Negative' END AS direction,
       row_number() OVER (ORDER BY abs(r) DESC, feature) <= 4 AS is_top
FROM ({inner}) t""")


@register("target_correlation", _target_corr_sql())
def q_target_correlation(spark, sf):
    """AG-19 + PRJ-19."""
    return P.target_correlation(dt(spark, sf), NUMERIC, "volume")



@register("histogram", WX(f"""
r AS (SELECT min(volume) AS lo, max(volume) AS hi FROM daily_traffic),
b AS (SELECT CAST(CASE WHEN (hi - lo) / 50.0e0 = 0 THEN 0
                  ELSE least(floor((volume - lo) / ((hi - lo) / 50.0e0)), 49) END AS INT) AS bin, lo, hi
      FROM daily_traffic, r WHERE volume IS NOT NULL)
SELECT bin, {R('lo + bin * ((hi - lo) / 50.0e0)', 4)} AS bin_low, {R('lo + (bin + 1) * ((hi - lo) / 50.0e0)', 4)} AS bin_high,
       count(*) AS count
FROM b GROUP BY bin, lo, hi"""))
def q_histogram(spark, sf):
    """AG-20."""
    return P.histogram(dt(spark, sf), "volume", 50)


@register("iqr_outliers", WX(f"""
q AS (SELECT quantile_cont(volume, 0.25) AS q1, quantile_cont(volume, 0.5) AS q2,
             quantile_cont(volume, 0.75) AS q3 FROM daily_traffic WHERE volume IS NOT NULL)
SELECT {R('q1', 4)} AS q1, {R('q2', 4)} AS median, {R('q3', 4)} AS q3, {R('q3 - q1', 4)} AS iqr,
       {R('q1 - 1.5e0 * (q3 - q1)', 4)} AS lower_fence, {R('q3 + 1.5e0 * (q3 - q1)', 4)} AS upper_fence,
       {R('min(volume) FILTER (WHERE volume >= q1 - 1.5e0 * (q3 - q1))', 4)} AS whisker_low,
       {R('max(volume) FILTER (WHERE volume <= q3 + 1.5e0 * (q3 - q1))', 4)} AS whisker_high,
       CAST(count_if(volume < q1 - 1.5e0 * (q3 - q1) OR volume > q3 + 1.5e0 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM daily_traffic, q WHERE volume IS NOT NULL GROUP BY q1, q2, q3"""))
def q_iqr_outliers(spark, sf):
    """AG-21."""
    return P.iqr_outliers(dt(spark, sf), "volume")


@register("ecdf", W(f"""
SELECT CAST(volume AS DOUBLE) AS value,
       {R('CASE WHEN count(*) OVER () = 1 THEN 0.0e0 ELSE (row_number() OVER (ORDER BY volume) - 1) / (count(*) OVER () - 1) END', 8)} AS position
FROM daily_traffic WHERE volume IS NOT NULL"""))
def q_ecdf(spark, sf):
    """AG-22."""
    return P.ecdf(dt(spark, sf), "volume")


@register("date_range", W("""
SELECT min(traffic_date) AS first_date, max(traffic_date) AS last_date, count(DISTINCT traffic_date) AS n_dates
FROM daily_traffic"""))
def q_date_range(spark, sf):
    """AG-41."""
    return dt(spark, sf).agg(F.min("traffic_date").alias("first_date"), F.max("traffic_date").alias("last_date"),
                             F.count_distinct("traffic_date").alias("n_dates"))


# Text readings of the daily numbers with faults at fixed places of the calendar: a unit, a comma, a dash, a blank, a NULL.
_DIRTY = [("%d % 7 = 0", "'n/a'"), ("%d % 11 = 0", "concat(%c, ' km')"), ("%d % 13 = 0", "'1,234'"), ("%d % 17 = 0", "NULL"),
          ("%d % 19 = 0", "'-'"), ("%d % 23 = 0", "''")]


def _dirty(c: str, i: int, day: str, text: str) -> str:
    """SQL for column ``c`` as dirty text; the i-th column takes its own fault."""
    when, then = _DIRTY[i % len(_DIRTY)]
    return f"CASE WHEN {when.replace('%d', day)} THEN {then.replace('%c', text)} ELSE {text} END AS {c}"


def _clean_numeric_sql():
    day = "(traffic_date - DATE '1970-01-01')"
    dirty = ", ".join(_dirty(c, i, day, f"CAST({c} AS VARCHAR)") for i, c in enumerate(NUMERIC))
    parts = []
    for i, c in enumerate(NUMERIC):
        fine = " AND ".join(f"TRY_CAST({p} AS DOUBLE) IS NOT NULL" for p in NUMERIC[:i]) or "true"
        parts.append(f"SELECT '{c}' AS column_name, CAST(count_if(TRY_CAST({c} AS DOUBLE) IS NULL AND {fine}) AS BIGINT) "
                     f"AS rows_removed FROM (SELECT {dirty} FROM daily_traffic)")
    return W("\nUNION ALL\n".join(parts))


def _dirty_text(spark, sf):
    return dt(spark, sf).selectExpr(*[_dirty(c, i, "unix_date(traffic_date)", f"CAST({c} AS STRING)")
                                      for i, c in enumerate(NUMERIC)])


@register("clean_numeric", _clean_numeric_sql())
def q_clean_numeric(spark, sf):
    """PRJ-01 report on dirty text readings: rows removed per column (sequential attribution, NULL removed too)."""
    return P.clean_numeric(_dirty_text(spark, sf), NUMERIC)[1]


@register("findings_table")
def q_findings_table(spark, sf):
    """SNK-07: the temporal findings as text rows (changes > 8 % with reasons, weekday gap, weather means)."""
    d = dt(spark, sf)
    ch = T.fluctuation_reasons(d).select(
        F.lit("monthly").alias("section"),
        F.format_string("%s: %s %.1f%% - %s", F.date_format("year_month", "MMMM yyyy"), F.col("direction"),
                        F.abs("pct_change"), F.col("reasons")).alias("line"))
    gap = T.weekday_weekend_gap(d).select(
        F.lit("weekday").alias("section"),
        F.format_string("%.0f vehicles on weekdays, %.0f at weekends: weekdays are %+.1f%% (%s)", F.col("weekday_avg"),
                        F.col("weekend_avg"), F.col("diff_pct"),
                        F.when(F.col("diff_pct") > 0, "higher").otherwise("lower")).alias("line"))
    w = T.group_stats(d, "weather").select(
        F.lit("weather").alias("section"), F.format_string("%-12s: avg volume = %.0f", "weather", "mean").alias("line"))
    from ..sources import sinks as K
    from ..streaming.jobs import scratch
    path = scratch(spark, "findings")
    K.write_findings(ch.unionByName(gap).unionByName(w).select(F.concat_ws("\t", "section", "line").alias("line")), path)
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].alias("section"), parts[1].alias("line"))


@register("corr_strength", W("""
SELECT feature, CASE WHEN abs(r) > 0.7 THEN 'Strong' WHEN abs(r) > 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength,
       CASE WHEN r > 0 THEN 'Positive' ELSE 'Negative' END AS direction
FROM (""" + "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, corr({c}, volume) AS r FROM daily_traffic"
                                 for c in NUMERIC if c != "volume") + ")"))
def q_corr_strength(spark, sf):
    """PRJ-19: strength and direction labels of the target correlations."""
    return P.target_correlation(dt(spark, sf), NUMERIC, "volume").select("feature", "strength", "direction")


@register("sort_series", W("""
SELECT road_name, traffic_date, CAST(row_number() OVER (PARTITION BY road_name ORDER BY traffic_date, road_name) AS INT) AS position
FROM daily_traffic"""))
def q_sort_series(spark, sf):
    """SL-02: series order per road (road, date) with an explicit tiebreak; sorted inside the window."""
    from pyspark.sql import Window
    w = Window.partitionBy("road_name").orderBy("traffic_date", "road_name")
    return dt(spark, sf).select("road_name", "traffic_date", F.row_number().over(w).alias("position"))


_SAMPLE_H = sql_arith_hash(SQL_DAILY_KEY, 42)


@register("sample_n", W(f"""
SELECT traffic_date, road_name, volume FROM daily_traffic
ORDER BY {_SAMPLE_H}, traffic_date, road_name LIMIT 2000"""))
def q_sample_n(spark, sf):
    """SL-07: min(2000, n) rows in a seeded hash order (deterministic, own seed; not the same rows as numpy)."""
    from ..operators import split as SP
    d = dt(spark, sf).withColumn("_h", SP.arith_hash(SP.daily_key(), 42))
    return d.orderBy("_h", "traffic_date", "road_name").limit(2000).select("traffic_date", "road_name", "volume")


@register("align_by_row", W("""
SELECT d.traffic_date, d.road_name, d.volume, o.weather_fog, o.weather_rain
FROM daily_traffic d JOIN (SELECT traffic_date, road_name, CAST(coalesce(weather = 'Fog', false) AS INT) AS weather_fog,
                                  CAST(coalesce(weather = 'Rain', false) AS INT) AS weather_rain FROM daily_traffic) o
  ON o.traffic_date = d.traffic_date AND o.road_name = d.road_name"""))
def q_align_by_row(spark, sf):
    """JN-06: a derived frame aligned back to its rows by the row key (equi join on (date, road))."""
    from ..operators.features import one_hot
    d = dt(spark, sf)
    dummies, _ = one_hot(d.select("traffic_date", "road_name", "weather"), "weather", "weather",
                         ["Clear", "Fog", "Rain"])
    return d.select("traffic_date", "road_name", "volume").join(
        dummies.select("traffic_date", "road_name", "weather_fog", "weather_rain"), ["traffic_date", "road_name"])
