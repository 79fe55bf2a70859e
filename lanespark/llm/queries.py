"""Registered queries of the training-data operators and their oracles."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, exact_topk, html_extract, langid, packing, periods, quality, sharding, simhash, sketch, url_filter, vecgraph
from .common import read, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@query
def op1_url_filter(spark, sf_dir):
    """Every page's URL by the rules, else by boosted trees trained on the URLs that the rules decide."""
    return url_filter.classify(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query
def op2_byte_bpe(spark, sf_dir):
    """Every document encoded by the merge transducer and decoded again by the streaming decoder."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query
def op3_language_id(spark, sf_dir):
    """The language of every document by a byte-level network trained on those not held out."""
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(langid.sample(docs)))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op4_quality(spark, sf_dir):
    """Quality of every document: its own evidence and its site's (host: source, path section: language)."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), F.col("source"),
                            F.col("lang"))


@query
def op5_embedding_near_dedup(spark, sf_dir):
    """Links of cosine 0.95 or more between all vectors, and their components."""
    return vecgraph.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.95)


ORACLES["op5_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
           embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
    FROM embeddings
), u AS (
    SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v WHERE ok
), link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_inner_product(a.e, b.e) >= 0.95
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.vec_id, CAST((SELECT count(*) FROM link l WHERE l.a = c.vec_id) AS BIGINT) AS n_links, c.component_id,
       c.vec_id = c.component_id AS kept
FROM comp c
"""


def _crc32(col) -> F.Column:
    return F.crc32(F.coalesce(F.col(col), F.lit("")).cast("binary"))


@query
def op6_fingerprints(spark, sf_dir):
    """Threshold-scaled sketches of every document, of its edited text, and their likeness.

    Likeness is the estimated share of the document's shingles that the other text holds, from the two fingerprints.
    """
    d = sketch.edited(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_chars", F.sha2(F.col("edited_text"), 256).alias("edited_sha256"),
                    sketch.as_string(F.col("sketch")).alias("fingerprint"),
                    sketch.as_string(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op7_simhash(spark, sf_dir):
    """SimHash components: 4-word shingles, links at 4 or fewer differing bits."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, max_bits=4)


@query
def op8_packing(spark, sf_dir):
    """All documents packed into sequences of at most 1024 tokens."""
    p = packing.pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                       public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, capacity=1024,
                       end_id=2)
    return packing.pack(p, capacity=1024)


@query
def op9_sharding(spark, sf_dir):
    """All documents in 24 shards of equal row counts, in shuffled order."""
    s = sharding.external_shuffle(read(spark, sf_dir, "documents"), n_shards=24)
    return s.select("doc_id", "size", _crc32("text").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
                    F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_html_extraction(spark, sf_dir):
    """The main text of every page by the recurrent block labeller."""
    pages = read(spark, sf_dir, "pages")
    found = html_extract.extract(pages, html_extract.train(pages))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op11_exact_topk(spark, sf_dir):
    """The 20 greatest integer inner products of every twentieth vector with all others."""
    v = exact_topk.quantised(read(spark, sf_dir, "embeddings"), scale=64)
    return exact_topk.top_k(v, F.col("id") % 20 == 0, k=20).withColumnRenamed("id", "vec_id")


ORACLES["op11_exact_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w),
           lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _with_period(doc_id, words):
    """The contract's texts: every tenth document (by its id's CRC) goes on periodically from a word on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query
def op12_periods(spark, sf_dir):
    """Periodic runs of at least 12 words of every document, its longest run, and its text without repetitions."""
    d = periods.runs(read(spark, sf_dir, "documents"), least=12, rewrite=_with_period)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"),
                                                              r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    sha = lambda c: F.lower(F.sha2(F.encode(c, "UTF-8"), 256))
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                    sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.size")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-best.size * 1000) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op13_collocations(spark, sf_dir):
    """Each language's 2000 best phrases of 2 to 5 words, counted by united transducers."""
    found = collocations.collocations(read(spark, sf_dir, "documents"), longest=5, least=100, limit=2000)
    return found.drop("k")


ORACLES["op13_collocations"] = r"""
WITH p AS (
    SELECT doc_id, coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                               'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
    FROM documents
), w AS (
    SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p
), totals AS (
    SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
    SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
    FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m
), f AS (
    SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM g GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
    SELECT lang, m, phrase, f AS a, ws, unnest(range(1, m)) AS k FROM f WHERE m >= 2
), scored AS (
    SELECT c.lang, c.phrase, c.m, c.a, c.k, x.f AS l, y.f AS r, t.n,
           CAST(CAST(c.a AS HUGEINT) * t.n * 1000 // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM cuts c JOIN totals t ON t.lang = c.lang
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:], ' ')
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
    SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(f) AS longer
    FROM f, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS j)
    WHERE m > j AND i + j - 1 <= m GROUP BY ALL
), kept AS (
    SELECT b.* FROM best b LEFT JOIN inner_parts s ON s.lang = b.lang AND s.phrase = b.phrase
    WHERE s.longer IS NULL OR 100 * s.longer < 100 * b.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
