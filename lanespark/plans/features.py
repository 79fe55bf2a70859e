"""Feature-engineering and selection queries (daily table, feature scores)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd, sql_rnd as R
from ..operators import features as FE
from ..operators import selection as S
from ..operators import split as SP
from ..sources import bindings as B
from .registry import register


def dt(spark, sf):
    return B.daily_traffic(spark, sf)


def WX(text: str, *names: str) -> str:
    ctes = [B.ORACLE_CTE[n].strip() for n in (names or ("daily_traffic",))]
    return "WITH " + ",\n".join(ctes) + ",\n" + text.strip()


# Window standard deviations of large values carry more float noise than
# sums; they are compared at 3 decimals.
STD_DIGITS = 3


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rnd(c, STD_DIGITS if "_rollstd" in c else digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


# ---- oracle text for the temporal stage ------------------------------------------
_W = "PARTITION BY road_name ORDER BY traffic_date, road_name"
_LAG_SQL = ",\n".join(f"lag({c}, {k}) OVER ({_W}) AS {c}_lag{k}" for c in FE.LAG_COLUMNS for k in FE.LAGS)
_ROLL_SQL = ",\n".join(
    f"avg({c}) OVER ({_W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS {c}_rollmean{k},\n"
    f"stddev_samp({c}) OVER ({_W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS {c}_rollstd{k}"
    for c in FE.LAG_COLUMNS for k in FE.ROLL_WINDOWS)
_TEMPORAL_CTE = f"""
t0 AS (SELECT *, CAST(traffic_date - (SELECT min(traffic_date) FROM daily_traffic) AS INT) AS days_since_start,
              CAST(year(traffic_date) AS INT) AS year, CAST(month(traffic_date) AS INT) AS month,
              CAST(day(traffic_date) AS INT) AS day, CAST(isodow(traffic_date) - 1 AS INT) AS day_of_week,
              CAST(isodow(traffic_date) >= 6 AS INT) AS is_weekend, CAST(weekofyear(traffic_date) AS INT) AS week_of_year,
              CAST(quarter(traffic_date) AS INT) AS quarter, CAST(dayofyear(traffic_date) AS INT) AS day_of_year
       FROM daily_traffic),
t1 AS (SELECT *, sin(2 * pi() * month / 12.0e0) AS month_sin, cos(2 * pi() * month / 12.0e0) AS month_cos,
              sin(2 * pi() * day_of_week / 7.0e0) AS dow_sin, cos(2 * pi() * day_of_week / 7.0e0) AS dow_cos,
              day_of_year / 365.0e0 AS year_progress,
              sin(2 * pi() * quarter / 4.0e0) AS quarter_sin, cos(2 * pi() * quarter / 4.0e0) AS quarter_cos,
              {_LAG_SQL},
              {_ROLL_SQL}
       FROM t0),
tf AS (SELECT *, volume - volume_lag3 AS traffic_trend_3d, avg_speed - avg_speed_lag3 AS speed_trend_3d FROM t1)"""

_INT_COLS = {"year", "month", "day", "day_of_week", "is_weekend", "week_of_year", "quarter", "day_of_year",
             "days_since_start", "incidents"}
_STR_COLS = {"road_name", "area_name", "weather", "roadwork", "traffic_date"}
_TEMPORAL_COLS = (["traffic_date", "road_name", "area_name", "volume", "avg_speed", "tti", "congestion",
                   "capacity_util", "incidents", "weather", "roadwork", "days_since_start", "year", "month", "day",
                   "day_of_week", "is_weekend", "week_of_year", "quarter", "day_of_year", "month_sin", "month_cos",
                   "dow_sin", "dow_cos", "year_progress", "quarter_sin", "quarter_cos"]
                  + [f"{c}_lag{k}" for c in FE.LAG_COLUMNS for k in FE.LAGS]
                  + [f"{c}_roll{s}{k}" for c in FE.LAG_COLUMNS for k in FE.ROLL_WINDOWS for s in ("mean", "std")]
                  + ["traffic_trend_3d", "speed_trend_3d"])


def _digits(c, digits):
    return STD_DIGITS if "_rollstd" in c else digits


def _sel(cols, src="tf", digits=6):
    return "SELECT " + ", ".join(c if c in _INT_COLS | _STR_COLS else f"{R(c, _digits(c, digits))} AS {c}"
                                 for c in cols) + f" FROM {src}"


def _keys_and(cols):
    return ["traffic_date", "road_name"] + cols


@register("temporal_features", WX(_TEMPORAL_CTE + "\n" + _sel(_TEMPORAL_COLS)), headline=True)
def q_temporal_features(spark, sf):
    """FP-04: 39 temporal columns in one shuffle (parity mode)."""
    return round_doubles(FE.temporal_features(dt(spark, sf)))


_LAGS = [f"{c}_lag{k}" for c in FE.LAG_COLUMNS for k in FE.LAGS]
_RMEAN = [f"{c}_rollmean{k}" for c in FE.LAG_COLUMNS for k in FE.ROLL_WINDOWS]
_RSTD = [f"{c}_rollstd{k}" for c in FE.LAG_COLUMNS for k in FE.ROLL_WINDOWS]


@register("lag_features", WX(_TEMPORAL_CTE + "\n" + _sel(_keys_and(_LAGS))))
def q_lag_features(spark, sf):
    """WN-01."""
    return round_doubles(FE.lag_features(dt(spark, sf)).select(*_keys_and(_LAGS)))


@register("rolling_mean", WX(_TEMPORAL_CTE + "\n" + _sel(_keys_and(_RMEAN))))
def q_rolling_mean(spark, sf):
    """WN-02."""
    return round_doubles(FE.rolling_features(dt(spark, sf)).select(*_keys_and(_RMEAN)))


@register("rolling_std", WX(_TEMPORAL_CTE + "\n" + _sel(_keys_and(_RSTD))))
def q_rolling_std(spark, sf):
    """WN-03."""
    return round_doubles(FE.rolling_features(dt(spark, sf)).select(*_keys_and(_RSTD)))


@register("trend_3", WX(_TEMPORAL_CTE + "\n" + _sel(_keys_and(["traffic_trend_3d", "speed_trend_3d"]))))
def q_trend_3(spark, sf):
    """WN-04."""
    return round_doubles(FE.trend_features(FE.lag_features(dt(spark, sf)))
                         .select(*_keys_and(["traffic_trend_3d", "speed_trend_3d"])))


_SAFE_ROLL_SQL = ",\n".join(
    f"{R(f'avg({c}) OVER ({_W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)', 6)} AS {c}_rollmean{k}"
    for c in FE.LAG_COLUMNS for k in FE.ROLL_WINDOWS)


@register("rolling_mean_safe", WX(f"SELECT traffic_date, road_name, {_SAFE_ROLL_SQL} FROM daily_traffic"))
def q_rolling_mean_safe(spark, sf):
    """WN-02 in leakage-safe mode: frames end at the previous row."""
    r = FE.rolling_features(dt(spark, sf), leakage="safe")
    return round_doubles(r.select(*_keys_and(_RMEAN)))


# ---- context stage ---------------------------------------------------------------
_CATS = ["Clear", "Fog", "Overcast", "Rain", "Windy"]
_DUMMIES = [f"weather_{c.lower()}" for c in _CATS[1:]]
_CONTEXT_CTE = f"""
c0 AS (SELECT *, CAST(isodow(traffic_date) >= 6 AS INT) AS is_weekend FROM daily_traffic),
ac AS (SELECT area_name, CAST(dense_rank() OVER (ORDER BY area_name) - 1 AS INT) AS area_encoded
       FROM (SELECT DISTINCT area_name FROM daily_traffic WHERE area_name IS NOT NULL)),
rc AS (SELECT road_name, CAST(dense_rank() OVER (ORDER BY road_name) - 1 AS INT) AS road_encoded
       FROM (SELECT DISTINCT road_name FROM daily_traffic WHERE road_name IS NOT NULL)),
c1 AS (SELECT c0.*, ac.area_encoded, rc.road_encoded,
              {", ".join(f"CAST(coalesce(weather = '{c}', false) AS INT) AS weather_{c.lower()}" for c in _CATS[1:])},
              CAST(coalesce(roadwork = 'Yes', false) AS INT) AS roadwork_flag
       FROM c0 LEFT JOIN ac ON ac.area_name = c0.area_name LEFT JOIN rc ON rc.road_name = c0.road_name),
cf AS (SELECT *, area_encoded * 100 + road_encoded AS area_road_interaction,
              avg_speed / (congestion + 1.0e0) AS speed_congestion_ratio,
              100.0e0 - capacity_util AS capacity_utilization_gap,
              volume / (avg_speed + 1.0e0) AS traffic_density,
              {", ".join(f"{d} * is_weekend AS {d}_weekend" for d in _DUMMIES)},
              incidents * is_weekend AS incident_weekend,
              roadwork_flag * capacity_util AS roadwork_traffic_impact
       FROM c1)"""
_INT_COLS |= {"area_encoded", "road_encoded", "roadwork_flag", "area_road_interaction", "incident_weekend",
              "is_weekend", *_DUMMIES, *[f"{d}_weekend" for d in _DUMMIES]}
_CONTEXT_COLS = (["area_encoded", "road_encoded", *_DUMMIES, "roadwork_flag", "area_road_interaction",
                  "speed_congestion_ratio", "capacity_utilization_gap", "traffic_density",
                  *[f"{d}_weekend" for d in _DUMMIES], "incident_weekend", "roadwork_traffic_impact"])


def _context(spark, sf):
    d = dt(spark, sf).withColumn("is_weekend", (F.weekday("traffic_date") >= 5).cast("int"))
    return FE.context_enrich(d, categories=_CATS)


@register("context_enrich", WX(_CONTEXT_CTE + "\n" + _sel(_keys_and(_CONTEXT_COLS), "cf")))
def q_context_enrich(spark, sf):
    """FP-05: 17 context columns (categories passed in: no extra job)."""
    return round_doubles(_context(spark, sf).select(*_keys_and(_CONTEXT_COLS)))


@register("label_encode", WX(_CONTEXT_CTE + "\n" + _sel(_keys_and(["area_encoded", "road_encoded"]), "cf")))
def q_label_encode(spark, sf):
    """WN-09."""
    d = FE.label_encode(FE.label_encode(dt(spark, sf), "area_name", "area_encoded"), "road_name", "road_encoded")
    return d.select(*_keys_and(["area_encoded", "road_encoded"]))


@register("one_hot_weather", WX(_CONTEXT_CTE + "\n" + _sel(_keys_and(_DUMMIES), "cf")))
def q_one_hot_weather(spark, sf):
    """FP-01: categories discovered with one small distinct() (driver metadata)."""
    d, names = FE.one_hot(dt(spark, sf), "weather", "weather", _CATS)
    return d.select(*_keys_and(names))


_P11 = ["area_road_interaction", "speed_congestion_ratio", "capacity_utilization_gap", "traffic_density"]
_P12 = [*[f"{d}_weekend" for d in _DUMMIES], "incident_weekend", "roadwork_traffic_impact"]


@register("context_features", WX(_CONTEXT_CTE + "\n" + _sel(_keys_and(_P11), "cf")))
def q_context_features(spark, sf):
    """PRJ-11."""
    return round_doubles(_context(spark, sf).select(*_keys_and(_P11)))


@register("cross_features", WX(_CONTEXT_CTE + "\n" + _sel(_keys_and(_P12), "cf")))
def q_cross_features(spark, sf):
    """PRJ-12."""
    return round_doubles(_context(spark, sf).select(*_keys_and(_P12)))


@register("first_seen_encode", B.with_bindings("""
SELECT area_name, CAST(row_number() OVER (ORDER BY first_id, area_name) - 1 AS INT) AS area_code
FROM (SELECT area_name, min(event_id) AS first_id FROM raw_readings WHERE area_name IS NOT NULL GROUP BY 1)""",
                                                "raw_readings"))
def q_first_seen_encode(spark, sf):
    """WN-10: area code by first appearance in event order."""
    r = B.raw_readings(spark, sf).select("area_name", "event_id")
    first = r.where(F.col("area_name").isNotNull()).groupBy("area_name").agg(F.min("event_id").alias("_first"))
    from pyspark.sql import Window
    return first.select("area_name", (F.row_number().over(Window.orderBy("_first", "area_name")) - 1)
                        .cast("int").alias("area_code"))


# ---- preparation: clean, split, scale, folds, blocks ------------------------------
_SPLIT_CTE = """
cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY road_name ORDER BY traffic_date) AS pos
                      FROM daily_traffic) WHERE pos > 7 AND volume IS NOT NULL),
hk AS (SELECT *, """ + SP.sql_arith_hash(SP.SQL_DAILY_KEY, 42) + """ AS h FROM cl),
sp AS (SELECT *, row_number() OVER (ORDER BY h, traffic_date, road_name) AS row_id,
              row_number() OVER (ORDER BY h, traffic_date, road_name) <= ceil(count(*) OVER () * 0.3e0) AS is_test
       FROM hk)"""


def _split_key():
    return SP.arith_hash(SP.daily_key(), 42)


def _clean(spark, sf):
    """PRJ-24 on the parity feature table: the first 7 rows of each road lose their lag-7."""
    ft = FE.temporal_features(dt(spark, sf))
    feats = [c for c in FE.feature_columns(ft)]
    return FE.drop_incomplete(ft, feats + ["volume"])


def _split(spark, sf):
    return SP.train_test_split(_clean(spark, sf).withColumn("h", _split_key()), ["h", "traffic_date", "road_name"])


@register("drop_incomplete", WX(_SPLIT_CTE + "\nSELECT traffic_date, road_name FROM cl"))
def q_drop_incomplete(spark, sf):
    """PRJ-24."""
    return _clean(spark, sf).select("traffic_date", "road_name")


@register("train_test_split", WX(_SPLIT_CTE + "\nSELECT traffic_date, road_name, row_id, is_test FROM sp"),
          headline=True)
def q_train_test_split(spark, sf):
    """FP-02: hash-ordered 70/30 split, n_test = ceil(0.3 n)."""
    return _split(spark, sf).select("traffic_date", "road_name", "row_id", "is_test")


@register("split_means", WX(_SPLIT_CTE + f"""
SELECT is_test, count(*) AS n, {R('avg(volume)', 4)} AS target_mean,
       {R('count(*) * 1.0e0 / sum(count(*)) OVER ()', 6)} AS fraction FROM sp GROUP BY 1"""))
def q_split_means(spark, sf):
    """AG-38."""
    g = _split(spark, sf).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.avg("volume").alias("_m"))
    tot = g.agg(F.sum("n").alias("_t"))
    return g.crossJoin(F.broadcast(tot)).select("is_test", "n", rnd("_m", 4).alias("target_mean"),
                                                rnd(F.col("n") / F.col("_t"), 6).alias("fraction"))


_SCALE = ["avg_speed", "tti", "congestion", "capacity_util"]


@register("standardize", WX(_SPLIT_CTE + """,
st AS (SELECT """ + ", ".join(f"avg({c}) AS {c}_mu, stddev_pop({c}) AS {c}_sd" for c in _SCALE) + """
       FROM sp WHERE NOT is_test)
SELECT traffic_date, road_name, """ + ", ".join(
    R(f"({c} - {c}_mu) / CASE WHEN {c}_sd = 0 THEN 1.0e0 ELSE {c}_sd END", 6) + f" AS {c}" for c in _SCALE)
    + " FROM sp, st"))
def q_standardize(spark, sf):
    """FP-03: fit on the training rows only (population std), apply to all rows."""
    sp = _split(spark, sf).select("traffic_date", "road_name", "is_test", *_SCALE)
    stats = SP.fit_scaler(sp.where(~F.col("is_test")), _SCALE)
    return round_doubles(SP.apply_scaler(sp, stats, _SCALE).select("traffic_date", "road_name", *_SCALE))


@register("contiguous_folds", WX(_SPLIT_CTE + """
SELECT traffic_date, road_name, CAST(ntile(5) OVER (ORDER BY row_id) AS INT) AS fold FROM sp WHERE NOT is_test"""))
def q_contiguous_folds(spark, sf):
    """WN-15: 5 contiguous folds over the training rows' order (sizes of ntile(5))."""
    from ..operators.ordering import global_row_number
    train = _split(spark, sf).where(~F.col("is_test")).select("traffic_date", "road_name", "row_id")
    j = global_row_number(train, ["row_id"], "_k", total="_n")
    return j.select("traffic_date", "road_name", SP.contiguous_folds(F.col("_k"), F.col("_n"), 5).alias("fold"))


@register("row_windows", WX(_SPLIT_CTE + """,
te AS (SELECT traffic_date, road_name, row_number() OVER (ORDER BY traffic_date, road_name) AS k,
              count(*) OVER () AS n FROM sp WHERE is_test)
SELECT traffic_date, road_name, CAST(floor((k - 1) / 100) + 1 AS INT) AS block FROM te
WHERE n // 100 >= 2 AND k <= (n // 100) * 100"""))
def q_row_windows(spark, sf):
    """WN-13: test rows in (date, road) order, blocks of 100, tail dropped."""
    test = _split(spark, sf).where(F.col("is_test")).select("traffic_date", "road_name")
    return SP.row_blocks(test, ["traffic_date", "road_name"], 100).select("traffic_date", "road_name", "block")


# ---- selection on given scores (feature_scores binding) ---------------------------
def fs(spark, sf):
    return B.feature_scores(spark, sf)


_RANK_CTE = """
mi AS (SELECT feature, mi_score, CAST(row_number() OVER (ORDER BY mi_score DESC, feature) AS INT) AS mi_rank FROM feature_scores),
rf AS (SELECT feature, rf_importance, CAST(row_number() OVER (ORDER BY rf_importance DESC, feature) AS INT) AS rf_rank
       FROM feature_scores),
cb AS (SELECT mi.feature, mi_score, mi_rank, rf_importance, rf_rank, (mi_rank + rf_rank) / 2.0e0 AS avg_rank
       FROM mi JOIN rf ON mi.feature = rf.feature),
sel AS (SELECT *, CAST(row_number() OVER (ORDER BY avg_rank, feature) AS INT) AS combined_rank,
               row_number() OVER (ORDER BY avg_rank, feature) <= greatest(15, floor(count(*) OVER () * 0.7e0)) AS selected
        FROM cb)"""


@register("rank_by_score", WX(_RANK_CTE + "\nSELECT feature, mi_score, mi_rank FROM mi", "feature_scores"))
def q_rank_by_score(spark, sf):
    """WN-08."""
    return S.rank_by_score(fs(spark, sf).select("feature", "mi_score"), "mi_score", "mi_rank")


@register("merge_rankings", WX(_RANK_CTE + "\nSELECT * FROM cb", "feature_scores"))
def q_merge_rankings(spark, sf):
    """JN-03."""
    return S.adaptive_selection(fs(spark, sf)).drop("combined_rank", "selected")


@register("adaptive_selection", WX(_RANK_CTE + "\nSELECT * FROM sel", "feature_scores"))
def q_adaptive_selection(spark, sf):
    """FP-10."""
    return S.adaptive_selection(fs(spark, sf))


@register("semi_selected", WX(_RANK_CTE + """
SELECT f.* FROM feature_scores f WHERE f.feature IN (SELECT feature FROM sel WHERE selected)""", "feature_scores"))
def q_semi_selected(spark, sf):
    """JN-05: keep the score rows whose feature was selected (left semi join)."""
    chosen = S.adaptive_selection(fs(spark, sf)).where("selected").select("feature")
    return fs(spark, sf).join(chosen, "feature", "left_semi")


@register("importance_share", WX(f"""
r AS (SELECT feature, rf_importance, CAST(row_number() OVER (ORDER BY rf_importance DESC, feature) AS INT) AS rank
      FROM feature_scores)
SELECT feature, rf_importance, rank, rf_importance / nullif(sum(rf_importance) OVER (), 0) AS share,
       sum(CASE WHEN rank <= 3 THEN rf_importance END) OVER () / nullif(sum(rf_importance) OVER (), 0) AS top_share
FROM r""", "feature_scores"))
def q_importance_share(spark, sf):
    """FP-13."""
    return S.importance_share(fs(spark, sf).select("feature", "rf_importance"), "rf_importance")


_FT_FEATS = ["avg_speed", "tti", "congestion", "capacity_util", "incidents"]


@register("f_test_topk", WX("""
c AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, corr({c}, volume) AS r, count(*) AS n FROM daily_traffic" for c in _FT_FEATS) + f"""),
f AS (SELECT feature, r, (n - 2) * r * r / nullif(1.0e0 - r * r, 0) AS f_score FROM c)
SELECT feature, {R('r', 6)} AS r, {R('f_score', 4)} AS f_score, rank FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY f_score DESC, feature) AS INT) AS rank FROM f) WHERE rank <= 3"""))
def q_f_test_topk(spark, sf):
    """FP-07: top-3 features by univariate F statistic."""
    s = S.f_test_topk(dt(spark, sf), _FT_FEATS, "volume", 3)
    return s.select("feature", rnd("r", 6).alias("r"), rnd("f_score", 4).alias("f_score"), "rank")


def _mi_sql():
    cols = _FT_FEATS + ["volume"]
    rng = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in cols)

    def b(c):
        w = f"(({c}_hi - {c}_lo) / 10.0e0)"
        return f"CAST(CASE WHEN {w} = 0 THEN 0 ELSE least(floor(({c} - {c}_lo) / {w}), 9) END AS INT)"
    long = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, {b(c)} AS bx, {b('volume')} AS yb FROM daily_traffic, rg "
        f"WHERE volume IS NOT NULL AND {c} IS NOT NULL" for c in _FT_FEATS)
    return WX(f"""
rg AS (SELECT {rng} FROM daily_traffic),
lg AS ({long}),
j AS (SELECT feature, bx, yb, count(*) AS nxy FROM lg GROUP BY ALL),
t AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, bx) AS nx,
             sum(nxy) OVER (PARTITION BY feature, yb) AS ny FROM j)
SELECT feature, {R('sum((nxy / n) * ln((nxy * n) / (nx * ny)))', 6)} AS mi_score FROM t GROUP BY 1""")


@register("mutual_information", _mi_sql())
def q_mutual_information(spark, sf):
    """FP-08 (re-aimed, binned MI): one joint-count shuffle for all features."""
    m = S.binned_mutual_information(dt(spark, sf), _FT_FEATS, "volume", 10)
    return m.select("feature", rnd("mi_score", 6).alias("mi_score"))


@register("topk_features", WX("""
r AS (SELECT feature, rf_importance, row_number() OVER (ORDER BY rf_importance DESC, feature) AS rk FROM feature_scores)
SELECT feature, rf_importance FROM r WHERE rk <= 15""", "feature_scores"))
def q_topk_features(spark, sf):
    """SL-05: head(15) of the importance ranking."""
    return S.rank_by_score(fs(spark, sf).select("feature", "rf_importance"), "rf_importance", "rk") \
        .where(F.col("rk") <= 15).select("feature", "rf_importance")


@register("feature_columns")
def q_feature_columns(spark, sf):
    """PRJ-23: every model feature with its category (by name keyword) and non-null count."""
    ft = FE.temporal_features(dt(spark, sf))
    ft = FE.context_enrich(ft, categories=_CATS)
    feats = FE.feature_columns(ft)
    one = ft.agg(*[F.count(c).alias(c) for c in feats])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(FE.classify_feature(c)).alias("category"),
                                                   F.col(c).alias("non_null")) for c in feats])).alias("_s")).select("_s.*")


@register("numeric_columns", B.with_bindings("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max "
    "FROM daily_traffic" for c, t in [("volume", "double"), ("avg_speed", "double"), ("tti", "double"),
                                      ("congestion", "double"), ("capacity_util", "double"), ("incidents", "int")]), "daily_traffic"))
def q_numeric_columns(spark, sf):
    """PRJ-27: numeric columns of the daily table with their type and value range."""
    d = dt(spark, sf)
    cols = FE.numeric_columns(d)
    types = dict(d.dtypes)
    one = d.agg(*[e for c in cols for e in (F.min(c).cast("double").alias(f"{c}__min"),
                                            F.max(c).cast("double").alias(f"{c}__max"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                                                   F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"))
                                          for c in cols])).alias("_s")).select("_s.*")


@register("require_columns", B.with_bindings("\nUNION ALL\n".join(
    f"SELECT '{k}' AS required, '{c}' AS column_name, {str(c != 'weather').lower()} AS present, count(*) AS rows FROM daily_traffic"
    for k, c in [("Area Name", "area_name"), ("Road/Intersection Name", "road_name"), ("Date", "traffic_date"),
                 ("Traffic Volume", "volume"), ("Average Speed", "avg_speed"), ("Travel Time Index", "tti"),
                 ("Congestion Level", "congestion"), ("Road Capacity Utilization", "capacity_util"),
                 ("Incident Reports", "incidents"), ("Weather Conditions", "weather"),
                 ("Roadwork and Construction Activity", "roadwork")]), "daily_traffic"))
def q_require_columns(spark, sf):
    """SRC-02: the required-column check on the daily table without its weather, one row per required column.

    The check itself must name just the missing column."""
    from ..sources.sinks import DAILY_CSV_NAMES, REQUIRED_DAILY, MissingColumns, require_columns
    d = dt(spark, sf).drop("weather")
    try:
        require_columns(d, [DAILY_CSV_NAMES[c] for c in REQUIRED_DAILY])
        present = set(d.columns)
    except MissingColumns as e:
        present = {DAILY_CSV_NAMES[c] for c in REQUIRED_DAILY if f"'{DAILY_CSV_NAMES[c]}'" not in str(e)}
    n = d.agg(F.count(F.lit(1)).alias("rows"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("required"), F.lit(DAILY_CSV_NAMES[c]).alias("column_name"),
                                                 F.lit(DAILY_CSV_NAMES[c] in present).alias("present"))
                                        for c in REQUIRED_DAILY])).alias("_s"), "rows").select("_s.*", "rows")
