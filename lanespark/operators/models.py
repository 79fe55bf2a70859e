"""The prepared training set, and MLlib's linear regressors with the reference's parameter mapping.

Training data is prepared once (``prepare_features``): cleaned feature table,
hash split, ``VectorAssembler``, train-fitted scaler; the assembled frames are
checkpointed to the shared checkpoint folder so iterative learners re-read a
short lineage (and survive executor loss). Only small metadata (p-length
coefficient vectors, importances, per-model metric rows) reaches the driver.

Parameter mapping to the reference's objectives (scikit-learn conventions):

* Ridge  ``||y-Xw||^2 + a||w||^2``      -> regParam = a * sd_pop(y) / n, L2 only, no standardization
* Lasso  ``(1/2n)||y-Xw||^2 + a||w||_1`` -> regParam = a, elasticNetParam = 1
* ElasticNet (l1_ratio l) -> reg = a*l + a*(1-l)*sd_pop(y), elasticNetParam = a*l / reg

Trees, forests and boosting are in ``operators.trees``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.regression import LinearRegression
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import features as FE
from . import split as SP

TARGET = "volume"


@dataclass
class Prepared:
    train: DataFrame          # row_id, label, features, features_scaled
    test: DataFrame
    feature_names: list[str]
    n_original: int = 0
    n_clean: int = 0
    stats: dict = field(default_factory=dict)


def split_key_daily() -> F.Column:
    """Portable hash order for (date, road) rows: reproducible 70/30 split."""
    return SP.arith_hash(SP.daily_key(), 42)


def prepare_features(daily: DataFrame, categories: list[str], leakage: str = "parity", test_fraction: float = 0.3,
                     checkpoint: bool = True) -> Prepared:
    """FP-06: features -> drop incomplete -> hash split -> assemble -> train-fitted scaler.

    The daily table (a row for each day and road, however many lines it sums up)
    and the cleaned feature table are materialised once in the shared checkpoint
    folder, so the source is read once and not for every code and first date; the split numbering, scaler statistics and assembled vectors are
    all derived from it (the assembled frame is persisted for the iterative
    learners and recomputed from the checkpoint if an executor is lost).
    """
    if checkpoint:
        daily = cut_lineage(daily)
    ft = FE.feature_table(daily, categories=categories, leakage=leakage)
    feats = FE.feature_columns(ft)
    clean = FE.drop_incomplete(ft, feats + [TARGET])
    clean = clean.select("traffic_date", "road_name", *[F.col(c).cast("double") for c in feats],
                         F.col(TARGET).cast("double").alias("label")).withColumn("_h", split_key_daily())
    if checkpoint:
        clean = cut_lineage(clean)
    sp = SP.train_test_split(clean, ["_h", "traffic_date", "road_name"], test_fraction)
    raw = VectorAssembler(inputCols=feats, outputCol="features").transform(sp) \
        .select("row_id", "is_test", "traffic_date", "road_name", "label", "features")
    # scaler statistics: ONE vector aggregate over the training rows (p means and
    # variances reach the driver: metadata), population std, zero std -> 1
    summ = raw.where(~F.col("is_test")).select(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")).first()["s"]
    n = float(summ["count"])
    mu = summ["mean"].toArray()
    sd = np.sqrt(summ["variance"].toArray() * ((n - 1) / n if n > 1 else 0.0))
    sd[sd == 0] = 1.0
    mu_arr = F.array(*[F.lit(float(v)) for v in mu])
    sd_arr = F.array(*[F.lit(float(v)) for v in sd])
    scaled = F.transform(vector_to_array("features"),
                         lambda x, i: (x - F.element_at(mu_arr, i + 1)) / F.element_at(sd_arr, i + 1))
    assembled = raw.withColumn("features_scaled", array_to_vector(scaled))
    if checkpoint:
        assembled = assembled.persist(StorageLevel.MEMORY_AND_DISK)
    train = assembled.where(~F.col("is_test")).drop("is_test")
    test = assembled.where(F.col("is_test")).drop("is_test")
    return Prepared(train, test, feats)


def label_sd_pop(train: DataFrame) -> tuple[float, int]:
    r = train.agg(F.stddev_pop("label").alias("s"), F.count(F.lit(1)).alias("n")).first()
    return float(r["s"] or 0.0), int(r["n"])


def ridge(alpha: float, sd_y: float, n: int, features: str = "features_scaled") -> LinearRegression:
    return LinearRegression(featuresCol=features, labelCol="label", regParam=alpha * sd_y / n,
                            elasticNetParam=0.0, standardization=False, solver="normal")


def lasso(alpha: float, features: str = "features_scaled", max_iter: int = 1000) -> LinearRegression:
    return LinearRegression(featuresCol=features, labelCol="label", regParam=alpha, elasticNetParam=1.0,
                            standardization=False, maxIter=max_iter, tol=1e-6)


def elastic_net(alpha: float, l1_ratio: float, sd_y: float, features: str = "features_scaled",
                max_iter: int = 1000) -> LinearRegression:
    reg = alpha * l1_ratio + alpha * (1 - l1_ratio) * sd_y
    return LinearRegression(featuresCol=features, labelCol="label", regParam=reg,
                            elasticNetParam=(alpha * l1_ratio / reg) if reg > 0 else 0.0,
                            standardization=False, maxIter=max_iter, tol=1e-6)


def linear(features: str = "features_scaled") -> LinearRegression:
    # exactly collinear features (parity mode) need a tiny ridge for the normal equations
    return LinearRegression(featuresCol=features, labelCol="label", regParam=1e-9, elasticNetParam=0.0,
                            standardization=False, solver="normal")


def coefficient_table(spark, model, names: list[str]) -> DataFrame:
    """FP-12: coefficients sorted by |coef| (p values: driver metadata)."""
    rows = [(n, float(c)) for n, c in zip(names, model.coefficients.toArray())]
    df = spark.createDataFrame(rows, "feature string, coefficient double")
    return df.withColumn("abs_coefficient", F.abs("coefficient")).orderBy(F.desc("abs_coefficient"), "feature")


def features_array(frame: DataFrame, col: str = "features_scaled") -> DataFrame:
    return frame.select("row_id", "label", vector_to_array(col).alias("x"))
