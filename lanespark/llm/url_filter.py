"""URL filter: host and path rules, then gradient-boosted trees on lexical features.

Rules decide the URLs they fit. They also label the training set: boosted trees
learn from those URLs' lengths, depth, digit share, character entropy,
parameter counts and the block rate of their host suffixes, and judge the URLs
that no rule fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanespark.session import cut_lineage

from .common import drawn

FEATURES = ("url_length", "host_length", "path_length", "labels", "depth", "digit_share", "hyphens", "entropy",
            "parameters", "query_length", "has_fragment", "suffix1_rate", "suffix2_rate")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct ``(rule, verdict)`` of the longest rule that fits, null if none does.

    ``rules``: (``host/path/``, ``allow`` or ``block``). A rule fits its host
    and all subdomains if the path starts with the rule's. Of rules of equal
    length ``block`` goes first, then the smaller string.
    """
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[1] != "block", r[0])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(s: Column) -> Column:
    """Bits per character: the sorted characters' runs in one pass."""
    chars = F.array_sort(F.filter(F.split(s, ""), lambda c: c != ""))
    n = F.char_length(s).cast("double")
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    term = lambda run: F.when(run > 1, run * F.log2(run)).otherwise(F.lit(0.0))

    def step(acc, c):
        same = acc["c"] == c
        return F.struct(c.alias("c"), F.when(same, acc["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
                        F.when(same, acc["sum"]).otherwise(acc["sum"] + term(acc["run"])).alias("sum"))

    total = F.aggregate(chars, start, step, lambda acc: acc["sum"] + term(acc["run"]))
    return F.when(n > 0, F.log2(F.greatest(n, F.lit(1.0))) - total / n).otherwise(F.lit(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (``url``, ``host``, ``path``) with lexical feature columns and the host suffixes of one and two labels."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    count = lambda s, chars: F.char_length(s) - F.char_length(F.translate(s, chars, ""))
    n = F.char_length(url)
    double = {
        "url_length": n, "host_length": F.char_length("host"), "path_length": F.char_length("path"),
        "labels": count(F.col("host"), ".") + 1, "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "digit_share": count(url, "0123456789") / F.greatest(n, F.lit(1)), "hyphens": count(F.col("host"), "-"),
        "entropy": _entropy(url), "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1),
        "query_length": F.char_length(query), "has_fragment": F.instr(url, "#") > 0,
    }
    return urls.withColumns({**{k: v.cast("double") for k, v in double.items()},
                             **_suffixes()})


def _suffixes() -> dict[str, Column]:
    return {"suffix1": F.substring_index("host", ".", -1), "suffix2": F.substring_index("host", ".", -2)}


def _with_rates(rows: DataFrame, stats: dict[str, DataFrame], base: float, fold: bool) -> DataFrame:
    """Smoothed block rates of the suffixes; with ``fold`` a row's own fold is left out."""
    for k in ("suffix1", "suffix2"):
        s = stats[k]
        if fold:
            rows = rows.join(s.select(F.col(k).alias("s"), F.col("fold").alias("f"), "n", "b"),
                             (F.col(k) == F.col("s")) & (F.col("fold") == F.col("f")), "left").drop("s", "f")
        else:
            rows = rows.join(s.where("fold = 0").select(F.col(k).alias("s"), F.col("all_n").alias("n"),
                                                        F.col("all_b").alias("b")),
                             F.col(k) == F.col("s"), "left").drop("s")
        rate = (F.coalesce("b", F.lit(0.0)) + 5 * base) / (F.coalesce("n", F.lit(0.0)) + 5)
        rows = rows.withColumn(k + "_rate", rate).drop("n", "b")
    return rows


def classify(urls: DataFrame, rules: Sequence[tuple[str, str]], train_rows: int = 20_000, folds: int = 4,
             trees: int = 12, depth: int = 4, seed: int = 3) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_probability``.

    ``urls`` has ``url`` and other columns that ride along, except those of
    the names above, which are replaced. A null URL, or one without ``://``, has empty host and path and no
    rule. The trees are fitted on about ``train_rows`` of the URLs that a rule
    decides, picked by hash (copies of a URL together); the suffix statistics
    count all of those URLs and are joined without a hint. If the rules label
    no URL, or all alike, the rest get that verdict (``allow`` if none) and a
    null probability.
    """
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "block_probability", "url")]
    whole = urls.select(F.struct(*own).alias("row") if own else F.lit(None).alias("row"), F.col("url").cast("string"),
                        host_of(F.col("url").cast("string")).alias("host"),
                        path_of(F.col("url").cast("string")).alias("path"))
    judged = whole.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    known = judged.where("hit is not null").select("url", "host", "path",
                                                   (F.col("hit.verdict") == "block").cast("double").alias("label"))
    in_fold = F.pmod(F.xxhash64("host"), F.lit(folds))
    counts = cut_lineage(known.withColumns({**_suffixes(), "fold": in_fold}).groupBy("suffix1", "suffix2", "fold").agg(
        F.count("*").cast("double").alias("n"), F.sum("label").alias("b")))
    total = counts.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    train = cut_lineage(known.where(drawn(["url"], train_rows, int(total["n"] or 0), seed)))
    lot = train.agg(F.count("*").alias("n"), F.sum("label").alias("b")).first()
    one_sided = not lot["n"] or lot["b"] in (0, lot["n"])
    if one_sided:
        rest = "block" if lot["n"] and lot["b"] else "allow"
        out = judged.select("row", "url", "host", "path", "hit", F.lit(rest).alias("guess"),
                            F.lit(None).cast("double").alias("block_probability"))
    else:
        base = total["b"] / total["n"]
        train = lexical(train).withColumn("fold", in_fold)
        train = cut_lineage(train)
        stats = {}
        for k in ("suffix1", "suffix2"):
            by_fold = counts.groupBy(k, "fold").agg(F.sum("n").alias("fn"), F.sum("b").alias("fb"))
            every = counts.groupBy(k).agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
            grid = every.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))))
            stats[k] = cut_lineage(grid.join(by_fold, [k, "fold"], "left").withColumns({
                "n": F.col("all_n") - F.coalesce("fn", F.lit(0.0)), "b": F.col("all_b") - F.coalesce("fb", F.lit(0.0))}))
        gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        fit_on = cut_lineage(gather.transform(_with_rates(train, stats, base, True)).select("features", "label")
                             .coalesce(2))
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(fit_on)
        scored = model.transform(gather.transform(_with_rates(lexical(judged), stats, base, False)))
        p = vector_to_array("probability")[1]
        out = scored.select("row", "url", "host", "path", "hit",
                            F.when(p >= 0.5, "block").otherwise("allow").alias("guess"), p.alias("block_probability"))
    return out.select(*(["row.*"] if own else []), "url", "host", "path", F.col("hit.rule").alias("rule"),
                      F.coalesce("hit.verdict", "guess").alias("verdict"), "block_probability")
