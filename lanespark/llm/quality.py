"""Quality classification by hierarchical empirical Bayes.

A logistic model on surface statistics of the whole text gives each document's
evidence. Sites add what their other documents say: grouped sums of that
evidence by host and by path section give Beta posteriors, a host's shrunk
towards the global rate and a section's towards its host, so that sparse sites
stay near their prior. The strengths of both priors are estimated from the data
by moments. A document's posterior combines its own likelihood ratio with the
posterior mean of its section, from which its own share is taken out.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanespark.session import cut_lineage

from .common import without

_CLASS = np.full(256, 5, np.int64)  # 5: symbols
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 0
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
_CLASS[[ord(c) for c in "0123456789"]] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4
_CLASS[128:] = 6

FEATURES = ("log_chars", "log_words", "upper", "lower", "digits", "spaces", "points", "symbols", "other_bytes",
            "word_length", "distinct_words", "top_word", "repeated_lines", "one_char_words", "symbol_words",
            "capital_words", "long_words")


def features(text: str | None) -> list[float]:
    """Surface statistics of one whole text (a null text is empty)."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(_CLASS[raw], minlength=7) / max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    alike = lambda test: sum(c for w, c in counts.items() if test(w)) / n
    return [math.log1p(len(text)), math.log1p(len(words)), *share.tolist(), min(40.0, len(text) / n) / 10,
            len(counts) / n, max(counts.values(), default=0) / n, 1 - len(set(lines)) / max(1, len(lines)),
            alike(lambda w: len(w) == 1), alike(lambda w: not w[-1].isalnum() and w[-1] not in ".,;:?'\")"),
            alike(lambda w: len(w) > 1 and w.isupper()), alike(lambda w: len(w) > 25)]


class Logistic:
    """Logistic regression with standardised inputs, fitted by Newton steps with a ridge penalty."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> "Logistic":
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (y - p) - penalty * w
            hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hess, grad)
            w = w + step * min(1.0, 5 / (1e-9 + np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -20, 20)
        return np.clip(self.weights[0] + z @ self.weights[1:], -30, 30)


def _with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` of ``docs`` as c0, c1, .. and the text's ``x`` (array of double)."""

    def run(batches):
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))],
                                             names=[*batch.schema.names[:-1], "x"])

    return _mapped(docs, keep, run, "x array<double>")


def _mapped(docs, keep, run, added):
    given = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col("text").cast("string").alias("t"))
    types = ", ".join(f"c{k} {given.schema[k].dataType.simpleString()}" for k in range(len(keep)))
    return given.mapInArrow(run, f"{types}, {added}")


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000) -> tuple[Logistic, float] | None:
    """The document classifier and the rate of good documents among its labels; None without both labels.

    Fitted on about ``rows`` labelled documents, picked by a hash of their ids.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(5)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    few = cut_lineage(known.where(draw < min(1.0, rows / n)).select(F.col("doc_id").cast("long").alias("id"),
                                                                    "quality"))
    x = _with_features(docs.where(draw < min(1.0, rows / n)), ["doc_id"])
    got = x.join(few, F.col("c0") == F.col("id")).select("c0", "x", "quality").collect()
    got = sorted((r["c0"], r["x"], r["quality"]) for r in got)
    y = np.array([r[2] for r in got], float)
    if not len(y) or y.min() == y.max():
        return None
    return Logistic.fit(np.array([r[1] for r in got]), y), float(y.mean())


def evidence(docs: DataFrame, model: Logistic, keep: list[str]) -> DataFrame:
    """``keep`` of ``docs`` as c0, c1, .. and ``log_odds`` of the document classifier."""
    mean, scale, weights = model.mean, model.scale, model.weights

    def run(batches):
        m = Logistic(mean, scale, weights)
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(batch.num_columns - 1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(m.log_odds(x))],
                                             names=[*batch.schema.names[:-1], "log_odds"])

    return _mapped(docs, keep, run, "log_odds double")


def _strength(groups: DataFrame, rate: float) -> float:
    """Prior weight in documents, by moments: how little the groups' rates differ beyond chance.

    ``groups`` has ``n`` and ``s`` (sum of probabilities). Weak evidence of differences gives a strong prior.
    """
    r = groups.where("n > 1").agg(F.sum("n").alias("n"), F.count("*").alias("k"),
                                  F.sum(F.col("n") * (F.col("s") / F.col("n") - rate) ** 2).alias("ss"),
                                  F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r["k"] or r["k"] < 2:
        return 50.0
    chance = rate * (1 - rate)
    spread = (r["ss"] - (r["k"] - 1) * chance) / max(1e-9, r["n"] - r["nn"] / r["n"])
    return float(np.clip(chance / spread - 1, 2.0, 1000.0)) if spread > 0 else 1000.0


def posterior(scored: DataFrame, base_rate: float) -> DataFrame:
    """Combine evidence with site posteriors.

    ``scored`` has ``host``, ``path`` (nulls are one empty site) and
    ``log_odds``; all columns stay. Adds ``p_doc``, ``host_rate`` and
    ``path_rate`` (posterior means, the document's own share taken out),
    ``quality`` (posterior probability) and ``kept`` (0.5 or more).
    """
    p = 1 / (1 + F.exp(-F.col("log_odds")))
    d = scored.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit("")), "p_doc": p})
    paths = cut_lineage(d.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s")))
    hosts = cut_lineage(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = min(0.999, max(0.001, (whole["s"] or 0.0) / max(1, whole["n"] or 0)))
    at_host, at_path = _strength(hosts, rate), _strength(paths, rate)
    sites = cut_lineage(paths.join(hosts.select(F.col("host").alias("h"), F.col("n").alias("hn"),
                                                F.col("s").alias("hs")), F.col("host") == F.col("h"))
                        .select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "hn", "hs"))
    d = d.join(sites, (F.col("host") == F.col("h")) & (F.col("path") == F.col("q")))
    host_rate = (F.col("hs") - F.col("p_doc") + at_host * rate) / (F.col("hn") - 1 + at_host)
    path_rate = (F.col("s") - F.col("p_doc") + at_path * F.col("host_rate")) / (F.col("n") - 1 + at_path)
    d = d.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    prior = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("path_rate")))
    odds = F.col("log_odds") - F.lit(math.log(base_rate / (1 - base_rate))) + F.log(prior / (1 - prior))
    d = d.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("quality") >= 0.5)
    return d.drop("h", "q", "n", "s", "hn", "hs")


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, rows: int = 4000) -> DataFrame:
    """One row per document: ``doc_id, host, path, p_doc, host_rate, path_rate, quality, kept``.

    ``host`` and ``path`` are expressions on ``docs``; null sites count as one
    empty site, a null text as an empty one, repeated rows as documents of
    their own. Without labels of both kinds every document has quality null
    and is kept. Other columns of either table are not read.
    """
    model = fit(docs, labels, rows)
    sited = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    if model is None:
        nothing = F.lit(None).cast("double")
        return sited.select("doc_id", F.coalesce("host", F.lit("")).alias("host"),
                            F.coalesce("path", F.lit("")).alias("path"),
                            *[nothing.alias(c) for c in ("p_doc", "host_rate", "path_rate", "quality")],
                            F.lit(True).alias("kept"))
    scored = cut_lineage(evidence(sited, model[0], ["doc_id", "host", "path"]).toDF("doc_id", "host", "path",
                                                                                    "log_odds"))
    return posterior(scored, model[1]).drop("log_odds")


def accepted(docs: DataFrame, labels: DataFrame, host: Column, path: Column, rows: int = 4000) -> DataFrame:
    """``docs``, all columns, without the documents that ``classify`` rejects.

    Rows that repeat a doc_id go only if all of them are rejected; rows with a null id are kept.
    """
    bad = classify(docs, labels, host, path, rows).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("kept").cast("int")).alias("any")).where("any = 0").select("doc_id")
    return without(docs, bad)
