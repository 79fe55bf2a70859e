"""SimHash, packing, sharding and sketches against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from lanespark.llm import packing, sharding, simhash, sketch
from lanespark.llm.common import components

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, cur = words + [cur] * bool(cur), ""
        else:
            cur += c
    if not words:
        return 0
    runs = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(nodes, near):
    comp = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def test_simhash_is_brute_force(docs):
    got = simhash.near_duplicates(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == len(texts)
    fps = sorted({slow_fingerprint(t) for _, t in texts})
    comp = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for i, t in texts:
        if i is not None:
            c = comp[slow_fingerprint(t)]
            first[c] = min(i, first.get(c, i))
    want = sorted((str(i), f"{slow_fingerprint(t):016x}", str(first.get(comp[slow_fingerprint(t)]))) for i, t in texts)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_spark_hash_is_the_contracts(spark):
    v = spark.sql("select xxhash64('the quick brown fox')").first()[0]
    assert v % 2 ** 64 == xxhash.xxh64_intdigest(b"the quick brown fox", 42)


def test_links_find_every_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 60, dtype=np.uint64)
    fps = set(base.tolist()) | {0, 2 ** 64 - 1, 3}
    for x in base.tolist():
        for bits in (1, 2, 3, 4, 5, 6):
            for b in rng.choice(64, bits, replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - 2 ** 64 if f >= 2 ** 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    comp = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    found = {r.node % 2 ** 64: r.component for r in components(simhash.links(df, 4)).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(found.get(f, f if f < 2 ** 63 else f - 2 ** 64), set()).add(f)
    want = {}
    for f in fps:
        want.setdefault(comp[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("block_rows", [1024, 100])
def test_a_ball_of_fingerprints_gives_few_edges(spark, block_rows):
    """Two balls of 1,009 fingerprints within 2 bits and a bridge: edges stay linear, the components are right."""
    centers = [0x0123456789ABCDEF, 0x7123456089ABCDE0 ^ 0x00FF00FF00FF00FF]
    fps = []
    for c in centers:
        fps += [c] + [c ^ (1 << i) for i in range(64)] + [c ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)
                                                          if (i + j) % 2 == 0]
    lone = [0xFFFFFFFF00000000, 0x00000000FFFFFFFF]
    fps = sorted(set(fps + lone))
    df = spark.createDataFrame([(f - 2 ** 64 if f >= 2 ** 63 else f,) for f in fps], "fp long").repartition(8)
    edges = simhash.links(df, 4, block_rows)
    n = edges.count()
    assert n <= 60 * len(fps) * (1 if block_rows == 1024 else 12)
    found = {r.node % 2 ** 64: r.component for r in components(edges).collect()}
    near = lambda f, c: (f ^ c).bit_count() <= 2
    for c in centers:
        assert len({found[f] for f in fps if near(f, c)}) == 1
    assert len({found[c] for c in centers}) == 2 and not any(f in found for f in lone)


def test_components_chain_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([(1, 1)], "src long, dst long")).count() == 0


def test_keep_first_keeps_one_of_each(docs, no_docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    comps = {r.component_id for r in simhash.near_duplicates(docs).collect()} - {None}
    assert sorted(i for i in ids if i is not None) == sorted(comps) and ids.count(None) == 1
    assert simhash.keep_first(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0


def test_pieces_equal_the_tokenizer(docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(JSON)
    want = []
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        n = len(ids)
        first = n if n <= 1024 else (n % 1024 or 1024)
        cuts = [0, *range(first, n + 1, 1024)]
        want += [(str(r.doc_id), p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
                 for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    p = packing.pieces(docs, JSON, RANKS, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in p.collect()) == sorted(want)


def test_fast_encoding_equals_the_tokenizer():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer
    tok, enc = Tokenizer.from_file(JSON), packing.BpeEncoder(JSON, RANKS, public_tokenizers.PATTERN)
    words = st.sampled_from(["the", "it's", "Ünï", "漢字", "12", "...", " ", "\n", "\t", "\r\n", " ", "don't", "'s",
                             "\x1c", "\x85", "é", "x" * 40, "!", " '", "<|endoftext|>", " ", "½"])

    @settings(max_examples=400, deadline=None)
    @given(st.lists(words | st.text(max_size=4), max_size=12), st.sampled_from(["", " ", "\n"]))
    def same(parts, glue):
        text = glue.join(parts)
        got = np.frombuffer(enc.encode(text), "<u4").tolist()
        assert got == tok.encode(text, add_special_tokens=False).ids
    same()


def check_packed(rows, capacity):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_packing_is_whole_gapless_and_tight(spark, docs, no_docs):
    rng = np.random.default_rng(1)
    rows = [(int(i % 700), 0, 0, int(n), 5) for i, n in enumerate(rng.integers(1, 1025, 3000))]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(items, part_rows=500).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((r[0], r[3]) for r in rows)
    n = check_packed(got, 1024)
    whole = packing.best_fit(np.array([r[3] for r in rows]), 1024)
    assert n <= len(whole) * 1.02 and len(whole) <= np.ceil(sum(r[3] for r in rows) / 1024) * 1.05
    p = packing.pack(packing.pieces(docs, JSON, RANKS, public_tokenizers.PATTERN)).collect()
    check_packed(p, 1024)
    assert packing.pack(packing.pieces(no_docs, JSON, RANKS, public_tokenizers.PATTERN)).count() == 0


def test_local_search_empties_bins():
    lengths = np.array([60, 30, 50, 40, 10, 10])
    bins = [[0, 1], [2, 4], [3], [5]]
    out = packing.local_search(bins, lengths, 100, full=1.0)
    assert sorted(i for b in out for i in b) == list(range(6)) and len(out) == 2
    assert all(lengths[b].sum() <= 100 for b in out)


def test_sharding_law_and_slots(docs, no_docs):
    s = sharding.external_shuffle(docs, n_shards=5, bucket_bytes=2000)
    rows = s.collect()
    assert len(rows) == docs.count()
    shards = {}
    for r in rows:
        assert r["size"] is not None
        shards.setdefault(r.shard, []).append(r.slot)
    counts = [len(shards.get(k, [])) for k in range(5)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    again = sharding.external_shuffle(docs, n_shards=5, bucket_bytes=2000).collect()
    place = lambda rs: sorted((str(r.doc_id), r.shard, r.slot) for r in rs)
    assert place(rows) == place(again)
    assert sharding.external_shuffle(no_docs).count() == 0


def test_edited_texts_and_likeness(docs, no_docs):
    got = sketch.edited(docs).collect()
    rows = sorted({(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None}, reverse=True)
    rows += [(None, "no id here at all")]
    want = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        want[i] = t[:len(t) - cut] + nxt[:cut]
    assert len(got) == docs.count()
    for r in got:
        assert r.edited_text == want[r.doc_id] and r.n_chars == len(r.text)
        assert hashlib.sha256(r.edited_text.encode()).hexdigest()
        assert r.sketch == sorted(set(r.sketch)) and r.sketch
        assert all(h >= 0 for h in r.sketch) or len(r.sketch) == 1
    assert sketch.edited(no_docs).count() == 0


def test_sketch_estimates_containment(spark):
    whole = " ".join(f"w{i}" for i in range(9000))
    part = " ".join(f"w{i}" for i in range(3000))
    row = spark.createDataFrame([(whole, part)], "a string, b string").select(
        sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b")).select(
        sketch.containment(F.col("a"), F.col("b")).alias("ab"), sketch.containment(F.col("b"), F.col("a")).alias("ba"),
        (F.size(F.array_except(F.col("b"), F.col("a"))) <= 8).alias("same"), F.size("a").alias("n")).first()
    assert row.ba > 0.998 and abs(row.ab - 1 / 3) < 0.05 and row.same and abs(row.n / 9004 - 1 / 2) < 0.02


SINGLE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}"


def slow_shingles(text, shingle=5):
    """All word shingles of a text, with empty words at either end."""
    words = regex.findall(rf"[{SINGLE}]|[^\x20\x09-\x0D{SINGLE}]{{1,16}}", text)
    padded = [None] * (shingle - 1) + words + [None] * (shingle - 1)
    return {tuple(padded[i:i + shingle]) for i in range(len(words) + shingle - 1)} if words else set()


def slow_sketch(text, shingle=5, fraction=0.5):
    """The kept hashes, from xxHash64 with seed 42 as Spark chains it over a shingle's word hashes."""
    kept = set()
    for s in slow_shingles(text, shingle):
        h = 42
        for w in s:
            word = xxhash.xxh64_intdigest(w.encode(), 42) if w is not None else 0
            h = xxhash.xxh64_intdigest(word.to_bytes(8, "little"), h)
        if h >> 32 < fraction * 2 ** 32:
            kept.add(h >> 32)
    return sorted(kept) or [-1 - (xxhash.xxh64_intdigest(text.encode(), 42) >> 33)]


def _texts():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz\U0001f600"), rng.integers(1, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in range(1, 21)] + ["x" * 900, "", "  ", "\t", None]
    texts += [" ".join(word() for _ in range(n)) for n in (60, 129, 130, 131, 400, 3000)]
    return texts + ["\u6f22\u5b57\u304b\u306a\u4ea4\u3058\u308a" * 9 + "abc", "same words", "same words"]


def test_sketches_and_likeness_at_all_lengths(spark):
    """Sketches equal a slow version; near_* are the share of the fingerprints' own hashes, at every length."""
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sketch.edited(docs).withColumns({
        "fingerprint": sketch.as_string(F.col("sketch")), "edited_fingerprint": sketch.as_string(F.col("edited_sketch"))
    }).collect()}
    for i, t in enumerate(texts):
        r, t, nxt = got[i], t or "", texts[i - 1] or ""
        assert r.sketch == slow_sketch(t) and r.edited_sketch == slow_sketch(r.edited_text)
        own, other, after = (set(x.split(",")) for x in (r.fingerprint, r.edited_fingerprint, got[(i - 1) % len(texts)].fingerprint))
        assert r.near_edited == len(own & other) / len(own) and r.near_next == len(own & after) / len(own)
        assert [int(x, 16) for x in r.fingerprint.split(",")] == [x % 2 ** 32 for x in r.sketch]
        a = slow_shingles(t)
        if len(a) > 200:
            for near, text in ((r.near_edited, r.edited_text), (r.near_next, nxt)):
                assert abs(near - len(a & slow_shingles(text)) / len(a)) < 0.1
        if not t.strip():
            assert r.near_next == float(t == nxt) and r.near_edited == float(t == r.edited_text)
    assert len({tuple(got[i].sketch) for i in range(24)}) == 24     # short and empty texts are told apart
    n = len(texts)
    assert got[24].fingerprint == got[21].fingerprint and got[n - 1].near_next == 1.0


def test_sketches_of_parts_merge(spark):
    parts = ["a b c d e f", "", "\t", "u v w"]
    df = spark.createDataFrame([(x, y) for x in parts for y in parts], "x string, y string")
    rows = df.select("x", "y", sketch.merge(sketch.sketch(F.col("x")), sketch.sketch(F.col("y"))).alias("m")).collect()
    for r in rows:
        both = set(slow_sketch(r.x)) | set(slow_sketch(r.y))
        assert r.m == sorted(h for h in both if h >= 0 or max(both) < 0)


def test_shard_files_are_written_whole(docs, tmp_path, spark):
    s = sharding.external_shuffle(docs, n_shards=3, bucket_bytes=2000)
    sharding.write_shards(s, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and set(r.shard for r in back.collect()) == {0, 1, 2}


@pytest.mark.parametrize("n", [1, 2])
def test_following_one_or_two_keys(spark, n):
    keys = spark.createDataFrame([(i, 5) for i in range(n)], "doc_id long, text_hash long")
    got = {(r.doc_id, r.next_doc_id) for r in sketch.following(keys).collect()}
    assert got == ({(0, 0)} if n == 1 else {(1, 0), (0, 1)})
