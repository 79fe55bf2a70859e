"""All fits over one prepared training set: every family once, on all training rows and fold by fold.

A family's predictions are a long frame ``(row_id, prediction)``: of all rows
by the model of all training rows, or of every training row by the model of the
other folds. Trees and boosters of several folds and sizes grow together;
linear models of the folds come from per-fold Gram matrices; neighbours of a
row are looked for outside its own fold. What was fitted is kept with the
training set (checkpointed) and shared by the queries.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.traffic import overfit_status
from ..session import cut_lineage
from . import metrics as MT
from . import models as ML
from . import neighbors as NB
from . import online as ON
from . import split as SP
from . import trees as T
from .ordering import global_row_number

LINEAR = ["Linear Regression", "Ridge Regression", "Lasso Regression", "ElasticNet"]
TREES = ["Decision Tree", "Random Forest", "Extra Trees"]
FAMILIES = [*LINEAR, "KNN", *TREES, "Gradient Boosting"]


def tree_spec(family: str, z: dict, fold: int | None = None, **more):
    """What to grow for a family of trees with sizes ``z``."""
    name = f"{family} {fold}"
    if family == "Decision Tree":
        return T.Forest(name, max_depth=z["tree_depth"], fold=fold, **more)
    if family == "Random Forest":
        return T.Forest(name, z["rf_trees"], z["rf_depth"], bootstrap=True, fold=fold, **more)
    if family == "Extra Trees":
        return T.Forest(name, z["et_trees"], z["et_depth"], random=True, fold=fold, **more)
    return T.Booster(name, z["gb_iter"], z["gb_lr"], z["gb_depth"], fold=fold, **more)


def _key(family: str, z: dict) -> tuple:
    """The sizes that matter to a family."""
    names = {"Ridge Regression": ["ridge_alpha"], "Lasso Regression": ["lasso_alpha"], "ElasticNet": ["enet_alpha", "enet_l1"],
             "KNN": ["knn_k", "knn_weights"], "Decision Tree": ["tree_depth"], "Random Forest": ["rf_trees", "rf_depth"],
             "Extra Trees": ["et_trees", "et_depth"], "Gradient Boosting": ["gb_iter", "gb_lr", "gb_depth"]}
    return (family, *[z.get(n) for n in names.get(family, [])])


@dataclass
class Fit:
    scores: DataFrame            # row_id, prediction
    seconds: float
    sums: DataFrame | None = None    # id, kind, value of trees and boosters: gains, losses


class Fits:
    """The fits of one prepared training set; ``folds`` contiguous folds over its rows' order."""

    def __init__(self, prep: ML.Prepared, folds: int = 5):
        self.prep, self.folds, self.p = prep, folds, len(prep.feature_names)
        self._full: dict[tuple, Fit] = {}
        self._held: dict[tuple, DataFrame] = {}
        self._kept: dict[str, object] = {}

    def _once(self, name, make):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def rows(self) -> DataFrame:
        """``row_id, fold, label, x`` of all rows, scaled features; fold 0 are the test rows."""
        def make():
            train = global_row_number(self.prep.train, ["row_id"], "_k", total="_n") \
                .withColumn("fold", SP.contiguous_folds(F.col("_k"), F.col("_n"), self.folds))
            both = train.select("row_id", "fold", "label", "features", "features_scaled").unionByName(
                self.prep.test.select("row_id", F.lit(0).alias("fold"), "label", "features", "features_scaled"))
            return cut_lineage(both.select("row_id", "fold", "label", vector_to_array("features_scaled").alias("x"),
                                           vector_to_array("features").alias("raw")))
        return self._once("rows", make)

    def matrix(self) -> DataFrame:
        """The rows with raw features as the trees read them."""
        return self._once("matrix", lambda: cut_lineage(T.matrix(self.rows(), "raw")))

    def edges(self) -> np.ndarray:
        """The matrix's thresholds: the same ones for every fit."""
        return self._once("edges", lambda: T.edges_of(self.matrix(), self.p))

    def grams(self) -> dict:
        train = self.rows().where("fold > 0")
        return self._once("grams", lambda: ON.block_grams(train, "fold", "x", "label", self.p))

    def label_stats(self):
        return self._once("label", lambda: ML.label_sd_pop(self.prep.train))

    # ---- on all training rows --------------------------------------------------------------------------------
    def estimator(self, family: str, z: dict):
        sd, n = self.label_stats()
        return {"Linear Regression": lambda: ML.linear(), "Ridge Regression": lambda: ML.ridge(z["ridge_alpha"], sd, n),
                "Lasso Regression": lambda: ML.lasso(z["lasso_alpha"]),
                "ElasticNet": lambda: ML.elastic_net(z["enet_alpha"], z["enet_l1"], sd)}[family]()

    def _neighbours(self, z: dict, held: bool) -> DataFrame:
        rows = self.rows().select("row_id", F.col("fold").cast("long").alias("fold"), "label", F.col("x").alias("v"))
        train = rows.where("fold > 0")
        grp = F.col("fold") if held else F.lit(None).cast("long")
        asked = (train if held else rows).select(F.col("row_id").alias("query_id"), "v", grp.alias("grp"))
        base = train.select(F.col("row_id").alias("neighbor_id"), "v", grp.alias("grp"))
        # a daily table fills a few regions only: smaller parts make enough tasks
        near = NB.nearest(asked, base, z["knn_k"], query_rows=4096)
        said = NB.knn_predict(near, train, "row_id", "label", z.get("knn_weights", "distance"))
        return said.select(F.col("query_id").alias("row_id"), "prediction")

    def full(self, family: str, z: dict) -> Fit:
        """The family fitted on all training rows, and its predictions of all rows."""
        key = _key(family, z)
        if key not in self._full:
            start = time.time()
            if family in LINEAR:
                model = self.estimator(family, z).fit(self.prep.train)
                seconds = time.time() - start
                every = self.prep.train.select("row_id", "features_scaled").unionByName(
                    self.prep.test.select("row_id", "features_scaled"))
                self._full[key] = Fit(cut_lineage(model.transform(every).select("row_id", "prediction")), seconds)
            elif family == "KNN":
                self._full[key] = Fit(cut_lineage(self._neighbours(z, False)), time.time() - start)
            else:
                self.grow([(family, z, tree_spec(family, z))])
        return self._full[key]

    def grow(self, wanted: list) -> None:
        """Fits full models ``(family, sizes, spec)`` of trees or boosters in one job for each kind."""
        for kind, run in ((T.Forest, T.forests), (T.Booster, T.boosters)):
            mine = [w for w in wanted if isinstance(w[2], kind)]
            if not mine:
                continue
            matrix, start = self.matrix(), time.time()
            sums = cut_lineage(run(matrix, [w[2] for w in mine], edges=self.edges))
            seconds = time.time() - start
            for i, (family, z, spec) in enumerate(mine):
                own = sums.where(F.col("spec") == i).drop("spec")
                for n in (*spec.prefixes, None):
                    scores = own.where(F.col("kind") == ("score" if n is None else f"score@{n}")).select(
                        F.col("id").alias("row_id"), F.col("value").alias("prediction"))
                    size = {"Random Forest": "rf_trees", "Extra Trees": "et_trees", "Gradient Boosting": "gb_iter"}.get(family)
                    whole = getattr(spec, "trees", None) or getattr(spec, "steps", 1)
                    sized = z if n is None else {**z, size: n}
                    self._full[_key(family, sized)] = Fit(scores, seconds / len(mine) * (1 if n is None else n / whole), own)

    # ---- fold by fold ----------------------------------------------------------------------------------------
    def held(self, wanted: list[tuple[str, dict]], prefixes: dict | None = None) -> dict[tuple, DataFrame]:
        """``{(family, sizes..): (row_id, prediction)}`` of the training rows by the models of the other folds."""
        prefixes = prefixes or {}
        todo = [(f, z) for f, z in wanted if _key(f, z) not in self._held]
        grown = [(f, z, [tree_spec(f, z, k, **({"prefixes": prefixes[f]} if f in prefixes else {}))
                         for k in range(1, self.folds + 1)]) for f, z in todo if f in TREES or f == "Gradient Boosting"]
        for kind, run in ((T.Forest, T.forests), (T.Booster, T.boosters)):
            mine = [g for g in grown if isinstance(g[2][0], kind)]
            if not mine:
                continue
            sums = cut_lineage(run(self.matrix(), [s for g in mine for s in g[2]], edges=self.edges))
            for i, (family, z, specs) in enumerate(mine):
                own = sums.where(F.col("spec").between(i * self.folds, (i + 1) * self.folds - 1))
                size = {"Random Forest": "rf_trees", "Extra Trees": "et_trees", "Gradient Boosting": "gb_iter"}.get(family)
                for n in (*specs[0].prefixes, None):
                    self._held[_key(family, z if n is None else {**z, size: n})] = own.where(
                        F.col("kind") == ("score" if n is None else f"score@{n}")).select(
                            F.col("id").alias("row_id"), F.col("value").alias("prediction"))
        for family, z in todo:
            if family == "KNN":
                self._held[_key(family, z)] = cut_lineage(self._neighbours(z, True))
            elif family in LINEAR:
                self._held[_key(family, z)] = self._linear_held(family, z)
        return {_key(f, z): self._held[_key(f, z)] for f, z in wanted}

    def _linear_held(self, family: str, z: dict) -> DataFrame:
        stats = self.grams()
        weights = []
        for f in range(1, self.folds + 1):
            rest = [s for k, s in stats.items() if k != f]
            G, xy, n = (sum(s[c] for s in rest) for c in ("G", "xy", "n"))
            if family == "Lasso Regression":
                w = ON.solve_l1(G, xy, n, z["lasso_alpha"])
            elif family == "ElasticNet":
                w = ON.solve_l1(G, xy, n, z["enet_alpha"], z["enet_l1"])
            else:
                w = ON.solve_ridge(G, xy, z["ridge_alpha"] if family == "Ridge Regression" else 0.0)
            weights.append(F.array(*[F.lit(float(v)) for v in w]))
        own = F.element_at(F.array(*weights), F.col("fold"))
        product = F.zip_with(F.concat("x", F.array(F.lit(1.0))), own, lambda a, b: a * b)
        return self.rows().where("fold > 0").select(
            "row_id", F.aggregate(product, F.lit(0.0), lambda s, v: s + v).alias("prediction"))

    # ---- what comes of them ----------------------------------------------------------------------------------
    def labels(self) -> DataFrame:
        return self.rows().select("row_id", "fold", "label")

    def cv(self, wanted: list[tuple[str, dict]], names: list[str] | None = None, **more) -> DataFrame:
        """``model, cv_r2, cv_std, folds``: mean and population deviation of the folds' R2."""
        held = self.held(wanted, **more)
        frames = [held[_key(f, z)].select("row_id", "prediction", F.lit(n).alias("model"))
                  for (f, z), n in zip(wanted, names or [f for f, _ in wanted])]
        every = frames[0]
        for f in frames[1:]:
            every = every.unionByName(f)
        per = MT.regression_metrics(every.join(self.labels(), "row_id"), "label", "prediction", ["model", "fold"])
        return per.groupBy("model").agg(F.avg("r2").alias("cv_r2"), F.stddev_pop("r2").alias("cv_std"),
                                        F.count("r2").cast("int").alias("folds"))

    def evaluate(self, wanted: list[tuple[str, str, dict]]) -> DataFrame:
        """ML-11 rows ``model, variant, train and test metrics, gap, time, status`` of full fits."""
        fits = [self.full(f, z) for f, _, z in wanted]
        every = None
        for (family, variant, _), fit in zip(wanted, fits):
            one = fit.scores.select("row_id", "prediction", F.lit(family).alias("model"), F.lit(variant).alias("variant"),
                                    F.lit(float(fit.seconds)).alias("train_time"))
            every = one if every is None else every.unionByName(one)
        rows = every.join(self.labels(), "row_id").withColumn("test", F.col("fold") == 0)
        m = MT.regression_metrics(rows, "label", "prediction", ["model", "variant", "train_time", "test"])
        pick = lambda c, test: F.max(F.when(F.col("test") == test, F.col(c)))
        out = m.groupBy("model", "variant", "train_time").agg(
            *[pick(c, False).alias(f"train_{c}") for c in ("r2", "rmse", "mae")],
            *[pick(c, True).alias(f"test_{c}") for c in ("r2", "rmse", "mae", "mape")])
        return out.withColumn("r2_gap", F.col("train_r2") - F.col("test_r2")) \
            .withColumn("overfit_status", overfit_status("r2_gap"))

    def wide(self, frames: dict[str, DataFrame]) -> DataFrame:
        """``row_id, fold, label`` and one prediction column for each name: one shuffle, no join for each model."""
        every = None
        for name, f in frames.items():
            one = f.select("row_id", "prediction", F.lit(name).alias("name"))
            every = one if every is None else every.unionByName(one)
        cols = every.groupBy("row_id").agg(*[F.max(F.when(F.col("name") == n, F.col("prediction"))).alias(n) for n in frames])
        return cols.join(self.labels(), "row_id")

    def stack_weights(self, oof: DataFrame, bases: list[str], alpha: float) -> np.ndarray:
        """Ridge on the bases' out-of-fold predictions; intercept last."""
        x = oof.select(F.lit(0).alias("_b"), F.array(*bases).alias("x"), "label")
        s = ON.block_grams(x, "_b", "x", "label", len(bases))[0]
        return ON.solve_ridge(s["G"], s["xy"], alpha)


def of(prep: ML.Prepared) -> Fits:
    """The fits kept with a training set."""
    if "fits" not in prep.stats:
        prep.stats["fits"] = Fits(prep)
    return prep.stats["fits"]
