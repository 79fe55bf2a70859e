"""Feature ranking and selection.

Scores come in as a small frame (one row per feature); ranking windows run on
that frame only. Univariate statistics (F-test, binned mutual information)
are computed from ONE aggregation over the data for all features at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's ---------------------------
SELECTION_RATIO = 0.7
MIN_SELECTED = 15
# -----------------------------------------------------------------------------


def rank_by_score(scores: DataFrame, score: str, rank: str, key: str = "feature") -> DataFrame:
    """WN-08: 1..n by score descending (name breaks ties)."""
    return scores.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), key)))


def n_select(p: int, ratio: float = SELECTION_RATIO, floor_n: int = MIN_SELECTED) -> int:
    return max(floor_n, int(p * ratio))


def adaptive_selection(scores: DataFrame, mi: str = "mi_score", rf: str = "rf_importance",
                       ratio: float = SELECTION_RATIO, key: str = "feature") -> DataFrame:
    """FP-10 (+ JN-03 merge, JN-05 flag): mean of the two ranks, keep max(15, int(p*ratio))."""
    a = rank_by_score(scores.select(key, mi), mi, "mi_rank", key)
    b = rank_by_score(scores.select(key, rf), rf, "rf_rank", key)
    m = a.join(b, key, "inner")
    m = m.withColumn("avg_rank", (F.col("mi_rank") + F.col("rf_rank")) / F.lit(2.0))
    total = m.agg(F.count(F.lit(1)).alias("_p"))
    w = Window.orderBy("avg_rank", key)
    keep = F.greatest(F.lit(MIN_SELECTED), F.floor(F.col("_p") * F.lit(ratio)))
    return m.crossJoin(F.broadcast(total)).withColumn("combined_rank", F.row_number().over(w)) \
        .withColumn("selected", F.col("combined_rank") <= keep).drop("_p")


def importance_share(scores: DataFrame, score: str, key: str = "feature", top: int = 3) -> DataFrame:
    """FP-13: importances sorted descending with the share held by the top ``top``."""
    r = rank_by_score(scores, score, "rank", key)
    tot = r.agg(F.sum(score).alias("_t"), F.sum(F.when(F.col("rank") <= top, F.col(score))).alias("_top"))
    return r.crossJoin(F.broadcast(tot)).select(
        key, score, "rank", F.try_divide(F.col(score), F.col("_t")).alias("share"),
        F.try_divide(F.col("_top"), F.col("_t")).alias("top_share"))


def f_test_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """FP-07: univariate regression F = (n-2) r^2 / (1 - r^2) from one aggregation."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.corr(c, target).alias(c) for c in features])
    long = one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r"))
                                                for c in features])).alias("_s")).select("_n", "_s.*")
    r2 = F.col("r") * F.col("r")
    return long.select("feature", "r", F.try_divide((F.col("_n") - 2) * r2, F.lit(1.0) - r2).alias("f_score"))


def f_test_topk(df: DataFrame, features: list[str], target: str, k: int) -> DataFrame:
    """FP-07: the k features with the largest F statistic."""
    s = rank_by_score(f_test_scores(df, features, target), "f_score", "rank")
    return s.where(F.col("rank") <= k)


def binned_mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """FP-08 (re-aimed): MI on equal-width bins of each feature and the target.

    The reference uses a k-nearest-neighbour MI estimator; this is an
    approximation with the same intent (rank features by dependence), computed
    as joint bin counts in one shuffle: sum p(x,y) ln(p(x,y) / (p(x) p(y))).
    """
    cols = features + [target]
    rng = df.agg(*[e for c in cols for e in (F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"))])
    j = df.select(*cols).crossJoin(F.broadcast(rng))

    def b(c):
        w = (F.col(f"{c}__hi") - F.col(f"{c}__lo")) / F.lit(float(bins))
        return F.when(w == 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col(c) - F.col(f"{c}__lo")) / w), F.lit(bins - 1))).cast("int")

    long = j.where(F.col(target).isNotNull()).select(
        b(target).alias("by"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), b(c).alias("bx")) for c in features])).alias("_s")) \
        .select("_s.feature", "_s.bx", "by").where(F.col("bx").isNotNull())
    joint = long.groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).alias("nxy"))
    wf = Window.partitionBy("feature")
    t = joint.select("feature", "bx", "by", "nxy",
                     F.sum("nxy").over(wf).alias("n"),
                     F.sum("nxy").over(wf.partitionBy("feature", "bx")).alias("nx"),
                     F.sum("nxy").over(wf.partitionBy("feature", "by")).alias("ny"))
    term = (F.col("nxy") / F.col("n")) * F.log((F.col("nxy") * F.col("n")) / (F.col("nx") * F.col("ny")))
    return t.groupBy("feature").agg(F.sum(term).alias("mi_score"))
