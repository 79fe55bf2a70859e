"""URL filter, HTML extraction, embedding graph and the pipeline against brute force."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanespark.llm import html_extract, queries, url_filter, vecgraph

SF = "/root/testdata/sf0.001"


def slow_url(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(r, v) for r, v in rules if path.startswith(r[r.index("/"):])
            and (host == r[:r.index("/")] or host.endswith("." + r[:r.index("/")]))]
    return host, path, max(fits, key=lambda r: len(r[0])) if fits else None


def test_rules_and_parts_are_brute_force(spark):
    urls = ["http://a.example.net/en/x?q=1", "https://EXAMPLE.net/EN/", "http://example.net", "http://net/", "x.net/en/",
            None, "", "http://org/fr/1#f", "ftp://sub.org/fr", "http://notexample.com/de/", "http://example.com/de/a/b",
            "a://b://c.net/d", "://x.net/", "http://a.net?x=/", "http://a.NET#/", "http://a.net\n/z", "http://u:p@h.net:80/",
            "http://" + "l" * 3000 + ".org/" + "p/" * 2000 + "?" + "&".join(["a=1"] * 500), "http://ÄÖ.Net/é?ü"]
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls * 2)],
                               "page_id long, url string, host string, label int")
    got = {r.page_id: r for r in url_filter.classify(df, queries.URL_RULES).collect()}
    assert len(got) == 2 * len(urls)
    for i, u in enumerate(urls * 2):
        host, path, hit = slow_url(u, queries.URL_RULES)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, hit[0] if hit else None), u
        assert r.verdict == hit[1] if hit else r.verdict in ("allow", "block")
    assert url_filter.classify(df.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.classify(df, ()).collect()} == {"allow"}
    assert {r.verdict for r in url_filter.classify(df, (("nowhere/", "block"), ("net/", "block"))).collect()} == {"block"}


def test_trees_learn_from_labelled_urls(spark):
    rows = [(i, f"http://{'spam' if i % 2 else 'good'}{i % 37}.site{i % 5}.zz/" + ("1234567890/" * 4 if i % 2 else "story"))
            for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = [(f"{'spam' if k % 2 else 'good'}{k}.site{s}.zz/", "block" if k % 2 else "allow")
             for k in range(18) for s in range(5)]
    got = url_filter.classify(df, rules).where("rule is null").collect()
    assert len(got) > 100
    assert np.mean([(r.verdict == "block") == ("1234567890" in r.path) for r in got]) > 0.95


def test_suffix_rates_count_every_labelled_url(spark, monkeypatch):
    seen, real = {}, url_filter._with_rates
    monkeypatch.setattr(url_filter, "_with_rates", lambda rows, stats, *a: seen.update(stats) or real(rows, stats, *a))
    kinds = [("net", "/"), ("org", "/ok/")]
    urls = [(f"http://h{i % 7}.site{i % 150}.{kinds[i % 2][0]}{kinds[i % 2][1]}{i}",) for i in range(1200)]
    df = spark.createDataFrame([*urls, ("http://free.example/x",)], "url string")
    out = url_filter.classify(df, (("net/", "block"), ("org/ok/", "allow")), train_rows=60, trees=2, depth=2)
    assert out.count() == 1201
    for k, n in (("suffix1", 2), ("suffix2", 150)):
        rows = seen[k].where("fold = 0").collect()
        assert len(rows) == n and all(r.all_n == 1200 / n for r in rows)
        assert all(r.all_b == (r.all_n if r[k].endswith("net") else 0) for r in rows)


def test_entropy_is_shannons(spark):
    texts = ["", "a", "aaaa", "abab", "hello world", "日本日"]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", url_filter._entropy(F.col("s")).alias("e"))
    for r in got.collect():
        p = np.array([r.s.count(c) / len(r.s) for c in set(r.s)])
        assert abs(r.e + (p * np.log2(p)).sum()) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>";</script></head>
<body><nav><ul><li><a href="/">Home</a><li><a href='/x>y'>News</a></ul></nav><!-- <p>gone</p> -->
<div class="cookie-banner">We use cookies.</div>
<article><h1>A &amp; B</h1><p>First <b>bold</b>&nbsp;text<br>goes   on.<p>Second &lt;p&gt; 1 &lt; 2 and 3 < 4.</p>
<div class="ad">Buy now</div><p hidden>secret</p><ul><li>one<li>two</ul></article>
<form><p>Your email</p><textarea>typed</textarea><button>Send</button></form>
<section class="comments"><p>Great post, thanks!</p></section><footer>&copy; 2024</footer></body></html>"""


def test_blocks_are_read_whole():
    texts = [b.text for b in html_extract.blocks(PAGE)]
    assert texts == ["Home", "News", "We use cookies.", "A & B", "First bold text goes on.",
                     "Second <p> 1 < 2 and 3 < 4.", "Buy now", "one", "two", "Your email", "Great post, thanks!",
                     "© 2024"]
    for odd in (None, "", "   ", "<", "<p", "<p>x</", "</div></div>", "<script>never ends", "<!-- never", "<a href='q",
                "&#xZZ; &#99999999;", "<p>" * 3000 + "deep"):
        html_extract.blocks(odd)
    assert [b.text for b in html_extract.blocks("plain text only")] == ["plain text only"]


def test_formulas_and_examples_are_text():
    page = "<p>Area is <math><mi>a</mi><mo>=</mo><mn>2</mn></math> units.</p><xmp><b>bold</b> &amp; raw</xmp><p>End.</p>"
    assert [b.text for b in html_extract.blocks(page)] == ["Area is a=2 units.", "<b>bold</b> &amp; raw", "End."]
    assert [b.text for b in html_extract.blocks("<div hidden><xmp>no</xmp></div><xmp>open")] == ["open"]


@pytest.mark.parametrize("attributes, shown", [
    ('class="overflow-hidden"', True), ('style="overflow:hidden"', True), ('href="/hidden-valley"', True),
    ('title="The hidden valley"', True), ('data-hidden="x"', True), ("aria-hidden=false", True),
    ('style="--x-display: none"', True), ('style="display:none; display:block"', True),
    ("title='display:none'", True), ("style=\"content:'; display:none'\"", True),
    ("hidden", False), ("class=a hidden", False), ('HIDDEN=""', False), ("aria-hidden=true", False),
    ('style="color:red; Display : none"', False), ('style="display:none!important; display:block"', False)])
def test_only_hidden_elements_are_silent(attributes, shown):
    page = f"<article {attributes}><h1>Title</h1><p>The text.</p></article><p>More.</p>"
    assert [b.text for b in html_extract.blocks(page)] == ["Title", "The text."] * shown + ["More."]


@pytest.mark.parametrize("page", [
    "<head><title>x</title><body><p>Text.</p>", "<html><head><title>x</title><meta a=b><p>Text.",
    "<head><script>y</script><div><p>Text.</p></div></html>", "<html><head><title>x</title>\n Text.<br>",
    "<head><noscript><p>no</p></noscript><span>Text.</span>",
    "<html><head><title>x</title></head><body><head><p>Text."])
def test_a_head_left_open_ends_at_the_body(page):
    assert [b.text for b in html_extract.blocks(page)] == ["Text."]


@pytest.mark.parametrize("page, found", [
    ("<div>x" * 60_000, 60_000), ("<b><p>x" * 30_000, 30_000), ("<b><div>x" * 20_000 + "</b>" * 20_000 + "y", 20_000),
    ("<i>" * 30_000 + "<hr>x" * 30_000, 30_000), ("<i>x</q>" * 40_000, 1)])
def test_deep_nesting_takes_linear_time(page, found):
    began = time.process_time()
    bs = html_extract.blocks(page)
    vectors = html_extract.BlockLabeller().block_vectors([bs])[0]
    assert len(bs) == found and len(vectors) == found and time.process_time() - began < 15


def test_paths_add_up_to_their_tokens():
    bs = html_extract.blocks('<body><div class="main page"><b><p id=x>one<ul><li>two</b>three</div><td>four')
    net = html_extract.BlockLabeller()
    assert [b.text for b in bs] == ["one", "twothree", "four"]
    for b, v in zip(bs, net.block_vectors([bs])[0]):
        want = net.w["path"][html_extract.path_ids(b.path)].sum(axis=0)
        assert np.array_equal(v[:net.path_dim], want)
        assert np.array_equal(net.path_vector(tuple(b.path), {}), want)


def test_a_hidden_inline_element_closed_across_blocks_ends_there():
    for page in ("<span hidden>no<div>no</span>yes</div>after", "<b hidden></hr><h1></html></b><b>yes <a>after"):
        assert " ".join(b.text for b in html_extract.blocks(page)) == "yes after"


@pytest.fixture(scope="module")
def labeller(spark):
    return html_extract.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_extraction_equals_the_article(spark, labeller):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages, labeller).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    right = 0
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        right += got[r.page_id] == "\n\n".join(b.text for b in html_extract.blocks(inner))
    assert right / len(rows) >= 0.98


def test_other_layouts(labeller):
    rng = np.random.default_rng(5)
    main = [html_extract.Block(("article", "h1"), "A title of the page", 0)] + [
        html_extract.Block(("article", "p"), f"Sentence {i} of the story goes on for a while and then it ends.", 0)
        for i in range(8)]
    wrong = total = 0
    for _ in range(60):
        page, truth = html_extract.relaid(main, [], rng)
        p = labeller.label([page])[0]
        wrong, total = wrong + ((p >= 0.5) != np.array(truth)).sum(), total + len(truth)
    assert wrong / total < 0.05


def test_extraction_edge_rows(spark, labeller):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<p>", None),
            (None, "u", "<article><p>" + "long text. " * 20000 + "</p></article>", "t"), (4, "u", PAGE, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df, labeller).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id in (1, 2, 3)] == [""] * 4
    assert max(len(r.text) for r in got) == len("long text. " * 20000) - 1
    page = next(r.text for r in got if r.page_id == 4)
    assert "First bold text goes on." in page and "cookies" not in page and "Great post" not in page
    assert html_extract.extract(df.limit(0), labeller).count() == 0
    assert html_extract.fit([]).label([[]])[0].size == 0


def brute(ids, vecs, threshold):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vecs]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for v, o in zip(vecs, ok)]
    n = len(ids)
    near = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(vecs[i]) == len(vecs[j])
             and float(unit[i] @ unit[j]) >= threshold] for i in range(n)]
    comp = list(range(n))
    for i in range(n):
        stack, seen = [i], {i}
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        comp[i] = min(ids[j] for j in seen)
    return sorted((ids[i], len(near[i]), comp[i], ids[i] == comp[i]) for i in range(n))


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(150, 16))
    rows = [list(map(float, np.float32(b))) for b in base]
    for k in range(40):
        rows += [list(map(float, np.float32(base[k] + rng.normal(scale=s, size=16)))) for s in (.02, .1, .25, .3)]
    rows += [rows[0]] * 5 + [[2 * x for x in rows[0]]] + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15,
             [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [-0.0] * 15 + [1.0]]
    rows += [list(map(float, np.float32(base[3] + rng.normal(scale=.02, size=16)))) for _ in range(120)]
    return rows


@pytest.mark.parametrize("size", [dict(), dict(region_rows=30, shard=10), dict(region_rows=8, overlap=2, shard=8)])
def test_graph_links_are_brute_force(spark, size):
    rows = vectors()
    ids = [int(i) for i in np.random.default_rng(0).permutation(len(rows))]
    df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, rows)], "vec_id long, embedding array<float>, label int")
    back = {r.vec_id: r.embedding for r in df.collect()}
    got = sorted(tuple(r) for r in vecgraph.near_duplicates(df, **size).collect())
    want = brute(ids, [back[i] for i in ids], 0.95)
    links_got, links_want = sum(r[1] for r in got), sum(r[1] for r in want)
    assert [r[0] for r in got] == [r[0] for r in want] and all(g[1] <= w[1] for g, w in zip(got, want))
    assert links_got >= 0.99 * links_want
    if not size:
        assert got == want


def test_audit_judges_every_node(spark, monkeypatch):
    assert vecgraph.recall([(3000, 3000)] * 80 + [(0, 2)] * 20) == 0.8 and vecgraph.recall([]) == 1.0
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(20, 8)), 2, axis=0) + 1e-3 * rng.normal(size=(40, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    real = vecgraph._search
    monkeypatch.setattr(vecgraph, "_search", lambda *a: real(*a).withColumn("links", F.lit(0).cast("long")))
    with pytest.raises(RuntimeError, match="recall"):
        vecgraph.near_duplicates(df, threshold=0.95)


def test_graph_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vecgraph.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vecgraph.near_duplicates(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_op5_equals_its_oracle(spark, duck):
    got = sorted(tuple(r) for r in queries.QUERIES["op5_embedding_near_dedup"](spark, SF).collect())
    want = sorted(duck.execute(queries.ORACLES["op5_embedding_near_dedup"]).fetchall())
    assert got == want


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline
    from lanespark.llm import langid, quality, simhash
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
        seen.append(now.count())
    assert seen == sorted(seen, reverse=True)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in now.collect()}
    comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(
        corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.STAGES[0][1](spark, docs, SF), SF)).collect()}
    assert kept == {c for c in comp.values()}
    clean = [i for i, q in labels.items() if q == 1]
    assert all(i in comp for i in clean), "a clean document went before near-dedup"
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == kept
    del langid, quality
