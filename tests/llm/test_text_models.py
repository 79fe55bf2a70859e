"""Byte-level BPE, language ID and quality against brute force, exact round trips and held-out accuracy."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lanespark.llm import bpe, langid, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tik():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.RANKS),
                             special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe._worker(queries.RANKS, public_tokenizers.PATTERN)


def test_transducer_is_byte_pair_encoding(coder, tik):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    encode = coder[0]
    words = st.sampled_from(["the", "it's", "Ünïté", "漢字", "12", "...", " ", "\n", "\t", "\r\n", " ", "aaaaaaaa",
                             "\x1c", "\x85", "x" * 60, "!", " '", "<|endoftext|>", "😀", "½", "====", "ciónmente"])

    @settings(max_examples=400, deadline=None)
    @given(st.lists(words | st.text(max_size=5), max_size=12), st.sampled_from(["", " ", "\n"]))
    def same(parts, glue):
        text = glue.join(parts)
        assert np.frombuffer(encode(text), "<u4").tolist() == tik.encode_ordinary(text)
    same()


def test_transducer_emits_after_bounded_lookahead_and_forgets_states(tik):
    t = bpe.MergeTransducer(bpe.load_ranks(queries.RANKS), limit=50)
    longest = max(map(len, bpe.load_ranks(queries.RANKS)))
    for word in (b"internationalisation" * 30, b"a" * 500, "éèêàùçœ".encode() * 20):
        assert t.encode(word) == tik.encode_ordinary(word.decode())
        assert all(sum(len(t._bytes[x]) for x in held) <= 2 * longest for _, rs in t._states for _, held in rs)


def test_border_check_is_byte_pair_encoding(tik):
    t = bpe.MergeTransducer(bpe.load_ranks(queries.RANKS))
    rng = np.random.default_rng(0)
    known = [x for x in t._token if x is not None]
    pairs = [(int(a), int(b)) for a, b in rng.choice(known, (4000, 2))]
    text = "internationalisation is theanthe aaaaaaaa ==== thereonthe ciónmente \n\n\n\n 1111111 " * 3
    ids = [i for i in tik.encode_ordinary(text)]
    pairs += list(zip(ids, ids[1:])) + [(a, a) for a in known[:3000]]
    for a, b in pairs:
        assert t._stay_apart(a, b) == (t._merges(t._bytes[a] + t._bytes[b])[-1] == [a, b]), (a, b)


def test_decoder_releases_whole_characters(coder, tik):
    decoder = coder[1]
    text = "naïve 漢字 😀👩‍👩‍👧 ñ é " * 5
    ids = np.array(tik.encode_ordinary(text))
    for step in (1, 2, 3, 7, len(ids)):
        parts = [decoder.feed(ids[a:a + step]) for a in range(0, len(ids), step)]
        for p in parts:
            p.decode("utf-8")       # no character is cut
        assert b"".join(parts) + decoder.finish() == text.encode()


def test_decoder_passes_bytes_that_are_no_text(coder):
    decoder = coder[1]
    ranks = bpe.load_ranks(queries.RANKS)
    raw = [b"\xff", b"\xc3", b"a", b"\xe2", b"\x82", b"\xac", b"\xf0", b"\x9f"]
    ids = np.array([ranks[b] for b in raw])
    assert b"".join(decoder.feed(ids[i:i + 1]) for i in range(len(ids))) + decoder.finish() == b"".join(raw)


def test_round_trip_of_every_document(docs, no_docs, tik):
    got = bpe.round_trip(docs, queries.RANKS, public_tokenizers.PATTERN, with_values=True).collect()
    want = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert sorted((str(r.doc_id), r.decoded) for r in got) == want
    for r in got:
        ids = np.array(tik.encode_ordinary(r.decoded), "<u4").tobytes()
        assert r.ids == ids and r.n_tokens == len(ids) // 4
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.round_trip(no_docs, queries.RANKS, public_tokenizers.PATTERN).count() == 0


def test_gru_gradients_are_the_slopes():
    net = langid.ByteBiGRU(["a", "b", "c"], 5, 1)
    ids, mask = langid.pad([b"abc ", b"de ", b"xyzuv "])
    y = np.array([0, 1, 2])
    _, g = net.gradients(ids, mask, y)
    for k, w in net.w.items():
        w64 = net.w[k] = w.astype(np.float64)
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        ends = []
        for step in (2e-3, -2e-3):
            w64[at] += step
            ends.append(net.gradients(ids, mask, y)[0])
            w64[at] -= step
        assert abs((ends[0] - ends[1]) / 4e-3 - g[k][at]) < 0.05 * abs(g[k][at]) + 1e-3


def test_language_of_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op3_language_id"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_rows(spark, docs, no_docs):
    net = langid.fit([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 5, steps=60)
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, net).collect()}
    assert {(5, "und", 0.0), (6, "und", 0.0), (7, "und", 0.0)} <= got
    assert sum(r.lang_pred == "und" for r in langid.predict(docs, net).collect()) == 3
    assert langid.predict(no_docs, net).count() == 0
    none = langid.fit([])
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    kept = langid.accepted(docs, net, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert langid.sample(docs.where("lang is null")) == []
    one = langid.fit([("only one", "xx")])
    assert {r.lang_pred for r in langid.predict(docs, one).collect()} == {"xx", "und"}


def test_texts_without_a_letter_have_no_language(spark):
    texts = ["²", "½ 12", "①", "٣ 4", "_ -", "\u200d", "ª", "x", "é", "漢"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = langid.fit([("the cat and the dog", "en"), ("le chat et le chien", "fr")], steps=5)
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, net).collect()}
    assert [got[i] == "und" for i in range(len(texts))] == [True] * 6 + [False] * 4


def test_long_words_are_trained_on_the_windows_that_are_read():
    word = "ab" * 40
    assert b"".join(langid.windows(word)) == word.encode() + b" "
    assert [len(w) for w in langid.windows(word)] == [32, 32, 17] and langid.windows("") == [b" "]
    net = langid.fit([("q" * 32 + "z" * 200, "zz"), ("q" * 32 + "k" * 200, "kk")], steps=120)
    sums = net.word_sums(["z" * 64, "k" * 64])
    assert [net.langs[i] for i in sums[:, :-1].argmax(axis=1)] == ["zz", "kk"]      # told by what follows the first 32


def test_least_score_follows_the_number_of_languages():
    assert langid.least_score(4) == pytest.approx(0.3) and langid.least_score(1) == pytest.approx(1.0)
    bounds = [langid.least_score(k) for k in (2, 3, 10, 100)]
    assert all(1 / k < b < 1.2 / k + 0.1 for k, b in zip((2, 3, 10, 100), bounds)) and bounds == sorted(bounds, reverse=True)


def test_word_sums_cover_every_position():
    net = langid.ByteBiGRU(["a", "b"], 4, 2)
    words = ["a", "漢字", "x" * 100, "word"]
    sums = net.word_sums(words)
    assert np.allclose(sums[:, -1], [len(w.encode()) + 1 for w in words]) and np.allclose(sums[:, :2].sum(1), sums[:, 2])


def test_prediction_does_not_depend_on_lang_source_or_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    net = langid.fit(langid.sample(docs, 20), steps=40)
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string")})
    rows = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict(d, net).collect())
    assert rows(docs) == rows(other)


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0)
    got = {r.doc_id: r.kept for r in quality.classify(docs, train, F.col("source"), F.col("lang")).collect()}
    rest = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).collect()
    assert len(got) == docs.count()
    assert sum(got[r.doc_id] == (r.quality == 1) for r in rest) / len(rest) >= 0.95


def test_sparse_sites_shrink_and_own_share_is_left_out(spark):
    rows = [("big", "a", 3.0)] * 200 + [("big", "b", -3.0)] * 100 + [("tiny", "a", 0.2), ("bad", "a", -4.0)] * 1 \
        + [("bad", "a", -4.0)] * 100 + [(None, None, 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, "
                                                                      "log_odds double")
    got = {r.doc_id: r for r in quality.posterior(df, 0.5).collect()}
    assert len(got) == len(rows)
    p = 1 / (1 + np.exp(-df.toPandas()["log_odds"].to_numpy()))
    rate = p.mean()
    tiny = next(r for r in got.values() if r.host == "tiny")
    assert abs(tiny.host_rate - rate) < 1e-9 and abs(tiny.path_rate - rate) < 1e-9    # its only document says nothing
    bad = next(r for r in got.values() if r.host == "bad")
    good = next(r for r in got.values() if r.host == "big" and r.path == "a")
    assert bad.path_rate < 0.25 < 0.75 < good.path_rate
    assert good.host_rate < good.path_rate


def test_quality_edge_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (8, 0), (9, 0), (None, 1), (77, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels, F.col("source"), F.lit(None))
    assert got.count() == docs.count() and got.where("quality is null").count() == 0
    unlabelled = quality.classify(docs, labels.limit(0), F.col("source"), F.col("lang"))
    assert unlabelled.count() == docs.count() and unlabelled.where("not kept").count() == 0
    assert quality.classify(no_docs, labels, F.col("source"), F.col("lang")).count() == 0
    kept = quality.accepted(docs, labels, F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 1
