"""Fits over one training set: the source is read once, thresholds are made once, slots are even and apart."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lanespark.operators import fits as FT
from lanespark.operators import models as ML
from lanespark.operators import trees as T

CATEGORIES = ["Clear", "Fog", "Overcast", "Rain", "Windy"]


def test_prepared_features_read_the_source_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    days = spark.range(0, 240, 1, 2).select(
        F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("id") / 4).cast("int")).alias("traffic_date"),
        F.format_string("Road %02d", F.col("id") % 4).alias("road_name"),
        F.format_string("Area %d", F.floor((F.col("id") % 4) / 2)).alias("area_name"),
        *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 10.0).alias(c)
          for c in ("volume", "avg_speed", "tti", "congestion", "capacity_util")],
        (F.col("id") % 3).cast("int").alias("incidents"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("id") % 5 + 1).cast("int")).alias("weather"),
        F.when(F.col("id") % 7 == 0, "Yes").otherwise("No").alias("roadwork"))
    prep = ML.prepare_features(days.mapInArrow(counted, days.schema), CATEGORIES)
    assert prep.train.count() + prep.test.count() > 100
    assert read.value == 240


@pytest.fixture
def prep(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 4))
    rows = spark.createDataFrame([(i, [float(v) for v in x], float(x[0] * 2 + x[1] * x[2])) for i, x in enumerate(X)],
                                 "row_id long, x array<double>, label double") \
        .select("row_id", "label", array_to_vector("x").alias("features"), array_to_vector("x").alias("features_scaled"))
    return ML.Prepared(rows.where("row_id >= 60"), rows.where("row_id < 60"), list("abcd"))


def test_thresholds_are_made_once_for_all_boosters(prep, monkeypatch):
    made, old = [], T.edges_of
    monkeypatch.setattr(T, "edges_of", lambda *a, **k: made.append(1) or old(*a, **k))
    f, z = FT.Fits(prep), dict(gb_iter=3, gb_lr=0.1, gb_depth=3)
    full = f.full("Gradient Boosting", z).scores.orderBy("row_id").collect()
    held = f.held([("Gradient Boosting", z)])[FT._key("Gradient Boosting", z)]
    assert len(made) == 1 and len(full) == 300 and held.count() == 240
    monkeypatch.undo()
    plain = T.boosters(f.matrix(), [FT.tree_spec("Gradient Boosting", z)]).where("kind = 'score'").orderBy("id").collect()
    assert [r.prediction for r in full] == pytest.approx([r.value for r in plain])


def test_thresholds_are_the_values_at_even_ranks(spark, prep):
    matrix = FT.Fits(prep).matrix()
    got = T.edges_of(matrix, 4, 15)
    x = np.array([np.frombuffer(r.x, "<f4") for r in matrix.where("fold > 0").collect()])
    for f in range(4):
        assert np.array_equal(got[f], np.sort(x[:, f])[[15 * (i + 1) - 1 for i in range(15)]])
    assert np.isinf(T.edges_of(matrix.where("fold < 0"), 4, 15)).all()


def test_slots_are_even_and_each_has_a_partition(prep):
    matrix = FT.Fits(prep).matrix()
    specs = [T.Forest(str(k), trees=50, max_depth=2, fold=k) for k in range(1, 6)]
    tops = {(i, t): T._Top(T.root_key(42, t)) for i in range(5) for t in range(50)}
    slots = T._slots(specs, tops, 8)
    sizes = [len(trees) for _, trees, _ in slots]
    assert max(sizes) - min(sizes) <= 1 and max(sizes) <= 32
    assert sorted((i, t) for i, trees, _ in slots for t in trees) == sorted(tops)
    dealt = T._dealt(matrix, specs, tops, slots)
    at = dealt.select("slot", F.spark_partition_id().alias("part")).distinct().collect()
    assert len({r.slot for r in at}) == len({r.part for r in at}) == len(at) == len(slots)
