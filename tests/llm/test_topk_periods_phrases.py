"""Exact top-k, periodic runs and collocations against brute force."""

import hashlib
import inspect
import random
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanespark.llm import collocations, exact_topk, periods
from lanespark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def oracle(key):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(Q.ORACLES[key])
    return rel.columns, sorted(rel.fetchall())


# ---- top-k -------------------------------------------------------------------------------------------------------
def slow_topk(rows, asks, k):
    """rows: (id, vector as dict)."""
    out = []
    for i, (q, v) in enumerate(rows):
        if not asks(q):
            continue
        scored = [(-sum(w * c.get(t, 0) for t, w in v.items()), cid is None, cid or 0, cid)
                  for j, (cid, c) in enumerate(rows) if j != i]
        out += [(q, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, block_rows, query_rows", [(3, 7, 4), (200, 9, 100), (5, 4096, 4096)])
def test_topk_is_brute_force(spark, k, block_rows, query_rows):
    rng = random.Random(k)
    rows = []
    for i in range(60):
        v = {t: rng.randint(-3, 3) for t in rng.sample(range(9), rng.randint(0, 6))}
        rows.append((i if i != 17 else None, v))
    rows += [(4, dict(rows[4][1])), (4, dict(rows[4][1])), (-8, {0: 2})]
    df = spark.createDataFrame([(i, list(v), list(v.values()), "x", 1) for i, v in rows],
                               "id long, terms array<long>, weights array<long>, row string, block int")
    got = exact_topk.top_k(df, F.col("id") % 4 == 0, k, block_rows, query_rows, cache_bytes=100)
    assert got.columns == ["query_id", "rank", "id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == slow_topk(rows, lambda q: q is not None and q % 4 == 0, k)


def test_topk_without_rows_queries_or_room(spark):
    schema = "id long, terms array<long>, weights array<long>"
    none = spark.createDataFrame([], schema)
    assert exact_topk.top_k(none, F.col("id") > 0).count() == 0
    one = spark.createDataFrame([(1, [0], [5])], schema)
    assert exact_topk.top_k(one, F.col("id") > 0).count() == 0            # nothing but itself
    two = spark.createDataFrame([(1, [0], [1 << 40]), (2, [0], [1 << 40])], schema)
    assert exact_topk.top_k(two, F.col("id") < 0).count() == 0            # no query
    with pytest.raises(Exception, match="64 bits"):
        exact_topk.top_k(two, F.col("id") > 0).collect()


def test_quantised_leaves_out_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [0.5, -0.01, 0.0]), (2, None), (3, [1.0, None]), (4, [nan]), (5, [inf]), (6, []),
                                (None, [1.0])], "vec_id long, embedding array<float>")
    got = {r.id: (r.terms, r.weights) for r in exact_topk.quantised(df, 64).collect()}
    assert got == {1: ([0, 1], [32, -1]), 6: ([], []), None: ([0], [64])}


def test_topk_query_equals_sql(spark):
    cols, want = oracle("op11_exact_topk")
    got = Q.QUERIES["op11_exact_topk"](spark, SF).select(*cols).collect()
    assert sorted(map(tuple, got)) == want and len(want) > 0


# ---- runs --------------------------------------------------------------------------------------------------------
def slow_runs(words, least):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, size = i, j + q - i
            if size >= max(least, 2 * q) and not any(
                    all(words[x] == words[x + p] for x in range(start, start + size - p)) for p in range(1, q)):
                out.append((start, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    words = [f"w{rng.randint(1, rng.choice([1, 2, 3, 30]))}" for _ in range(rng.randint(0, 90))]
    for _ in range(rng.randint(0, 4)):
        if words:
            s, p, e = rng.randrange(len(words)), rng.randint(1, 9), rng.randint(1, 5)
            words = words[:s] + words[s:s + p] * e + words[s:]
    return words[:150]


def test_automaton_finds_exactly_the_runs():
    rng = random.Random(7)
    for _ in range(250):
        words, least = some_words(rng), rng.randint(2, 16)
        want = slow_runs(words, least)
        assert sorted(periods.squares_to_runs(words, least), key=lambda r: (r[0], r[2])) == want
        if least >= 4:
            assert periods.find_runs(words, least) == want
        dropped = {x for s, k, p in want for x in range(s + p, s + k)}
        assert periods.collapse(words, want) == [w for x, w in enumerate(words) if x not in dropped]


def test_a_long_text_of_one_word_and_a_fibonacci_word():
    assert periods.find_runs(["a"] * 50_000) == [(0, 50_000, 1)]
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    assert periods.find_runs(b) == slow_runs(b, 12) != []


def test_runs_of_documents(spark, docs, no_docs):
    text = "x y z " * 6 + "end"
    more = docs.unionByName(spark.createDataFrame([(20, text, None, None, 0, "", ""), (20, text, None, None, 0, "", "")],
                                                  docs.schema))
    got = periods.runs(more).collect()
    assert len(got) == more.count()
    by_text = {r.doc_id: r for r in got}
    assert [tuple(r) for r in by_text[20].runs] == [(0, 18, 3)] and by_text[20].collapsed == "x y z end"
    assert by_text[5].n_words == 0 and by_text[5].collapsed == "" and by_text[5].runs == []
    assert by_text[11].n_words == 6000 and by_text[11].runs == []
    assert by_text[None].collapsed == "no id here at all"
    assert periods.runs(no_docs).count() == 0


def test_runs_query_is_brute_force(spark):
    import re
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, some = {}, 0
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = slow_runs_fast(words, 12)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        dropped = {x for s, k, q in found for x in range(s + q, s + k)}
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        left = " ".join(w for x, w in enumerate(words) if x not in dropped)
        some += bool(found)
        want[doc_id] = (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
           for r in Q.QUERIES["op12_periods"](spark, SF).collect()}
    assert len(got) == len(rows) and some > 10
    assert {k: got[k] for k in want} == want


def slow_runs_fast(words, least):
    """As slow_runs, each period's matches by numpy."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([codes[w] for w in words])
    out = []
    for q in range(1, len(words) // 2 + 1):
        same = np.r_[False, x[:-q] == x[q:], False]
        edge = np.nonzero(same[1:] != same[:-1])[0]
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s + q >= max(least, 2 * q):
                part = x[s:e + q]
                if not any((part[:-p] == part[p:]).all() for p in range(1, q)):
                    out.append((int(s), int(e - s + q), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


# ---- collocations ------------------------------------------------------------------------------------------------
def test_transducers_keep_their_counts():
    rng = np.random.default_rng(2)
    parts, total = [], Counter()
    for _ in range(4):
        words = sorted({b"w%d" % i for i in rng.integers(0, 12, 8)})
        rows = np.full((200, 4), -1, np.int64)
        for r in rows:
            m = rng.integers(1, 5)
            r[:m] = rng.integers(0, len(words), m)
        rows = rows[np.lexsort(rows.T[::-1])]
        for r in rows:
            g = [words[i] for i in r if i >= 0]
            total.update(tuple(g[:m]) for m in range(1, len(g) + 1))
        t = collocations.Transducer.from_sorted(words, rows, np.ones(len(rows), np.int64))
        small = t.minimal()
        assert sum(len(x[0]) for x in small.levels) < sum(len(x[0]) for x in t.levels)
        again = small.tree()
        assert all((a == b).all() for x, y in zip(t.levels, again.levels) for a, b in zip(x, y))
        parts.append(small)
    union = collocations.Transducer.union(parts)
    got = {}
    for m in range(1, 5):
        rows, f = union.paths(m)
        got.update({tuple(union.words[i] for i in r): int(c) for r, c in zip(rows, f)})
    assert got == dict(total)


def slow_collocations(rows, least, limit):
    import re
    f, n = Counter(), Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = {}
    for (lang, *g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        inside = [h for h, b in f.items() if h[0] == lang and len(h) - 1 > len(g) and b >= least and b >= a
                  and any(list(h[i:i + len(g)]) == g for i in range(1, len(h) - len(g) + 1))]
        if inside:
            continue
        score, k = min((1000 * a * n[lang] // (f[(lang, *g[:k])] * f[(lang, *g[k:])]), k) for k in range(1, len(g)))
        out.setdefault(lang, []).append((" ".join(g), k, a, f[(lang, *g[:k])], f[(lang, *g[k:])], n[lang], score))
    return sorted((lang, r + 1, *p) for lang, ps in out.items() for r, p in enumerate(
        sorted(ps, key=lambda p: (-p[6], -p[2], p[0].encode()))[:limit]))


@pytest.mark.parametrize("sizes", [dict(), dict(shard_words=40, range_words=30, ask_rows=5),
                                   dict(shard_words=70, range_words=25, most_ranges=3, filter_bits=15)])
def test_collocations_are_brute_force(spark, sizes):
    rng = random.Random(11)
    vocabulary = ["The", "of", "new", "york", "City", "hall", "naïve", "漢字", "\x1cx", "a" * 40] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(90):
        words = [rng.choice(vocabulary[:rng.choice([2, 8, 50])]) for _ in range(rng.randint(0, 25))]
        if i % 3 == 0:
            words += ["of", "the", "New", "York", "city", "hall"] * rng.randint(1, 2)
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "!?", "\x0b"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "fr", None])))
    rows += [(None, "en"), ("", "de"), (rows[0][0], rows[0][1]), ("the " * 300, "en")]
    df = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, range int, phrase string") \
        .repartition(3)
    got = collocations.collocations(df, least=4, limit=25, **sizes)
    assert got.columns == ["lang", "rank", "phrase", "k", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == slow_collocations(rows, 4, 25)


def test_collocation_tasks_hold_little():
    """What a task holds of a text of many words: a shard of half a million words, batches of some MB, no large peak."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(30_000)])
    texts = [" ".join(words[rng.integers(0, 30_000, 1000)]).encode() for _ in range(1200)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})
    every = SimpleNamespace(value=np.full(1 << 17, 255, np.uint8))
    ranges = collocations.Ranges([], 0, 1, 1)
    size = inspect.signature(collocations.counts).parameters["shard_words"].default
    assert max(len(c) for _, _, c in collocations._shards([batch], size)) < 1_000_000
    run = collocations._count(1, 2, size, every, every, ranges)
    tracemalloc.start()
    try:
        pieces = [(b.num_rows, b.nbytes) for b in run([batch])]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert max(n for _, n in pieces) < 20_000_000
    assert peak < 250_000_000


def test_collocations_of_nothing(spark, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    blank = spark.createDataFrame([(None, None), (" \n\t.", "en")], "text string, lang string")
    assert collocations.collocations(blank).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).count() == 0


def test_collocations_query_equals_sql(spark):
    cols, want = oracle("op13_collocations")
    got = Q.QUERIES["op13_collocations"](spark, SF).select(*cols).collect()
    assert sorted(map(tuple, got)) == want
