"""Corpus pipeline: stages over the documents, each written as Parquet and read again by the next.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanespark.llm import langid, packing, quality, simhash
from lanespark.llm.common import ship
from lanespark.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language (a text without a letter is in none)."""
    net = langid.fit(langid.sample(docs))
    return langid.accepted(docs, net, langid.least_score(len(net.langs)))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (host: source, path section: language)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, labels, F.col("source"), F.col("lang"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: 4-word shingles, links at 4 or fewer bits."""
    return simhash.keep_first(docs, shingle=4, max_bits=4)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token pieces in sequences of at most 1024 tokens."""
    p = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"),
                       public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, capacity=1024,
                       end_id=2)
    return packing.pack(p, capacity=1024)


def _stage(fn):
    @functools.wraps(fn)
    def run_stage(spark, docs, sf_dir):
        ship(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


STAGES = [("language_id", _stage(language)), ("quality_classifier", _stage(good)),
          ("simhash_near_dedup", _stage(near_duplicates)), ("best_fit_packing", _stage(pack))]

#: Trained models and hashes that SQL does not have; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what is between them goes to the shared folder."""
    shared = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{shared}/{k}-{name}")
        docs = spark.read.parquet(f"{shared}/{k}-{name}")
    return docs
