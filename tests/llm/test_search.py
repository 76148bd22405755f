"""Page extraction, nearest neighbours, decontamination and the pipeline."""

import itertools
import re
import tempfile

import numpy as np
import pytest
from llm_cases import SMOKE, edge, empty, small_docs  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate as D
from tidemark.llm import html_main as H
from tidemark.llm import packing, shingle_join
from tidemark.llm import permutation_index as PI
from tidemark.llm import queries as Q

# ------------------------------------------------------------------ pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar">
<header class="top"><a href="/">Home</a></header><nav><ul><li><a href=x>One</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div>
<div class='post post-12' id="main-content"><header><h1>The &eacute;t&#233; title</h1><span>by a person</span></header>
<p>First paragraph, with <b>bold</b> and <a href="q>r">a link</a>, long enough to win<br>after a break.
<p>Second&nbsp;paragraph &#8217;s text &amp; more words to have weight.</p><!-- <p>hidden</p> -->
<script>var x = "<p>no</p>";</script><div class="ad-slot">Buy now</div>
<ul><li>item one<li>item two</ul><table><tr><td>cell</td><td>other</td></tr></table><form><p>Sign up</p></form></div>
<section class="comments"><p>A reader's long comment that must not be there at all.</p></section>
<aside><p>Related things</p></aside><footer>&copy; 2020</footer></body></html>"""
TEXT = ("The été title First paragraph, with bold and a link, long enough to win after a break. "
        "Second paragraph ’s text & more words to have weight. item one item two cell other")


@pytest.mark.parametrize("page,text", [
    ('<svg class="i"/><article><p>Whole article.</p></article>', "Whole article."),
    ('<article><p>One <svg><title>icon</title><path d="M0"/></svg>two.</p></article>', "One two."),
    ("<article><p>Before.</p><select><option>x<p>After.</p></article>", "Before. x After."),
    ('<article><h2 class="section-header">Head</h2><p class="market-share">Share rose.</p>'
     '<p class="notice-period">A month.</p><p class="comment-on-law">On law.</p></article>', "Head Share rose. A month. On law."),
    ('<article><p>Kept.</p><div class="cookie-notice">Gone</div><p class="share-buttons">Gone</p><div class="ad">Gone</div>'
     "</article>", "Kept."),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p></article>", "Let x=2 here."),
    ("<article><p title=it's>It's text.</p><p title='a>b'>More.</p></article>", "It's text. More."),
    ('<div class="post"><p>Short post of some words here.</p></div><section class="responses"><p>Reader says great things at '
     "some length, longer than the post is by far, and again great.</p></section>", "Short post of some words here."),
])
def test_extract_loses_and_leaks_nothing(page, text):
    assert H.extract(f"<html><body>{page}</body></html>", None) == text


def test_extract():
    assert H.extract(PAGE, None) == TEXT
    assert H.extract(PAGE, "html>body.no-sidebar>div.post.post-#") == TEXT
    assert H.extract(PAGE, "html>body>nothing") == TEXT
    assert H.extract("", None) == ""
    assert H.extract("<p>unclosed <b>tag", None) == "unclosed tag"
    assert H.extract("<article><p>cut &am", None) == "cut &am"


def test_pages_take_the_path_of_their_host(spark, empty):
    page = lambda main, side: f"<body><div class=c{main[:1]}><p>{main}</p></div><div class=s><p>{side}</p></div></body>"
    rows = [(i, "https://u@Big.example:80/x", page("a" * 60, "b" * 20), "z") for i in range(30)]
    rows += [(90, "http://big.example/y", page("a" * 10, "b" * 99), "z"),       # the host outvotes the page
             (91, "http://other/y", page("a" * 10, "b" * 99), "z"),
             (92, None, page("a" * 10, "b" * 99), None), (93, "http://big.example/", None, None),
             (93, "http://big.example/", None, None), (None, "nonsense", "", None), (94, "http://big.example/q", "<p>x", "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    for few in (50_000, 0):                                                     # broadcast, and the salted join
        H.BROADCAST_HOSTS = few
        got = H.extract_pages(pages).collect()
        H.BROADCAST_HOSTS = 50_000
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        by = {r.page_id: r.text for r in got}
        assert by[0] == "a" * 60 and by[90] == "a" * 10 and by[91] == "b" * 99 and by[92] == "b" * 99
        assert by[93] == "" and by[None] == "" and by[94] == "x"
    assert H.extract_pages(empty.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"),
                                        F.col("text").alias("html"))).count() == 0


def test_page_query_matches_the_articles(spark):
    """The test pages keep their text in one article element: read here by patterns alone."""
    import html

    got = {r.page_id: r.text for r in Q.QUERIES["op3_html_main_text"](spark, SMOKE).collect()}
    for r in spark.read.parquet(f"{SMOKE}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == " ".join(b for b in blocks if b)


# ------------------------------------------------------------------ vectors

def exact_neighbours(rows, k, every):
    out = {}
    for q, v in rows:
        if q % every == 0:
            near = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in rows if i != q)
            out[q] = [(i, s) for s, i in near[:k]]
    return out


def test_nearest_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    good += [(100 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]       # one very common vector
    bad = [(200, None), (205, [0.0] * 8), (210, [float("nan")] + [1.0] * 7), (215, [float("inf")] + [1.0] * 7),
           (220, [None] + [1.0] * 7), (225, []), (230, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    got = {}
    for r in PI.nearest(df, k=7, query_every=5, share=1.0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = exact_neighbours(good, 7, 5)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [got[q][k][0] for k in range(1, 8)] == [i for i, _ in near]
        assert np.allclose([got[q][k][1] for k in range(1, 8)], [-s for _, s in near])


def test_fewer_candidates_than_asked_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in PI.nearest(df, k=20).collect()] == [(0, 1, 1, 0.5)]
    assert PI.nearest(df.limit(0)).count() == 0


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(PI, "SHARD_ROWS", 700)
    monkeypatch.setattr(PI, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(2000, 24))
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in PI.nearest(df, k=10, query_every=40, least=100, share=0.2).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact_neighbours(rows, 10, 40)
    hit = sum(len(got[q] & {i for i, _ in near}) for q, near in want.items())
    assert hit >= 0.9 * 10 * len(want)


# ------------------------------------------------------------------ decontamination

def brute_contaminated(docs, items):
    norm = lambda t: [w for w in re.split(r"[ \t-\r]+", (t or "").lower().translate(
        str.maketrans("", "", D.PUNCTUATION))) if w]
    out = {}
    for doc, text in docs:
        h, found = norm(text), set()
        for item, item_text in items:
            g = norm(item_text)
            size = min(D.OVERLAP, len(g))
            for p in range(len(h) - D.SPAN + 1):
                for q in range(len(g) - D.SPAN + 1):
                    if any(all(h[p + k] == g[q + k] for k in range(D.SPAN) if m[k]) for m in D.MASKS):
                        for s in range(max(0, q - p, q + D.SPAN - size), min(q, len(g) - size, len(h) - p + q - size) + 1):
                            if sum(h[s + p - q + k] == g[s + k] for k in range(size)) >= D.needed(len(g)):
                                found.add(item)
        out[doc] = found
    return out


@pytest.mark.parametrize("limit", [500_000, 0])
def test_contaminated(spark, limit):
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(30)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([20, 40, 13, 9, 7, 6, 2, 25])] + [(50, None), (None, "")]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.integers(0, 60))]
        if i % 2:
            passage = items[int(rng.integers(8))][1].upper().split()
            passage = [word() if rng.random() < 0.12 else w + "," for w in passage]
            text[len(text) // 2:len(text) // 2] = passage
        docs.append((i, " ".join(text)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    rows = D.report(d, b, broadcast_seeds=limit).collect()
    want = brute_contaminated(docs, items)
    assert {r.doc_id: set(r["items"]) for r in rows} == want
    assert all(r.contaminated == bool(r["items"]) and r.n_items == len(r["items"]) for r in rows)
    kept = {r.doc_id for r in D.clean(d, b).collect()}
    assert kept == {i for i, found in want.items() if not found}


@pytest.mark.parametrize("size", range(1, D.OVERLAP + 1))
def test_masks_cover_every_tolerated_pattern(size):
    tolerated = size - D.needed(size)
    for gone in itertools.combinations(range(size), tolerated):
        assert any(all(at + k not in gone for k, kept in enumerate(mask) if kept)
                   for mask in D.SEEDS[size] for at in range(size - len(mask) + 1)), gone


@pytest.mark.parametrize("limit", [500_000, 0])
def test_contaminated_with_every_tolerated_pattern(spark, limit):
    """Items of 1 to 14 words with the tolerated substitutions at all places, against all
    alignments, and no masks."""
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 15)]
    docs = []
    for n, text in items:
        size = min(n, D.OVERLAP)
        for more in (0, 1):
            for gone in itertools.combinations(range(size), min(size, size - D.needed(n) + more)):
                docs.append((len(docs), "a " + " ".join("z" if k in gone else w for k, w in enumerate(text.split())) + " b"))
    want = {}
    for doc, text in docs:
        h = text.split()
        want[doc] = {n for n, t in items for g in [t.split()] for size in [min(n, D.OVERLAP)]
                     for p in range(len(h) - size + 1) for q in range(n - size + 1)
                     if sum(a == b for a, b in zip(h[p:p + size], g[q:q + size])) >= D.needed(n)}
    rows = D.report(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4),
                    spark.createDataFrame(items, "item_id bigint, text string"), broadcast_seeds=limit).collect()
    assert {r.doc_id: set(r["items"]) for r in rows} == want


def test_decontamination_edges(spark, edge, empty):
    item = "The quick brown fox jumps over the lazy dog. A second line of plain words"
    b = spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id bigint, text string")
    rows = D.report(edge, b).collect()
    assert len(rows) == edge.count()
    assert sorted((r.doc_id or 0, r.contaminated) for r in rows if r.contaminated) == [(0, True), (1, True), (7, True), (7, True)]
    left = D.clean(edge, b)
    assert left.columns == edge.columns and left.count() == edge.count() - 4
    assert D.report(empty, b).count() == 0 and D.clean(edge, b.limit(0)).count() == edge.count()


def test_decontamination_plan_is_native_and_probes_in_one_stage(small_docs, spark):
    plan = D.report(small_docs, spark.read.parquet(f"{SMOKE}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan) and "BroadcastHashJoin" in plan


# ------------------------------------------------------------------ pipeline

def test_stage_order_and_columns(spark, small_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "packing"]
    docs, base = small_docs, tempfile.mkdtemp(prefix="tidemark-stages-")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMOKE).write.parquet(f"{base}/{name}")
        seen[name] = docs = spark.read.parquet(f"{base}/{name}")
        if name != "packing":
            assert docs.columns == small_docs.columns and docs.dtypes == small_docs.dtypes
    ids = {n: {r.doc_id for r in df.select("doc_id").collect()} for n, df in seen.items()}
    assert ids["language"] == {r.doc_id for r in small_docs.where("text rlike '[a-zA-Z]'").collect()}
    assert ids["lines"] == ids["language"]
    # near duplicates: one of each group of what the lines stage left
    groups = {r.doc_id: r.component_id for r in shingle_join.components(seen["lines"]).collect()}
    assert ids["near_duplicates"] == set(groups.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").collect()]
    texts = [(r.doc_id, r.text) for r in seen["near_duplicates"].collect()]
    assert ids["decontamination"] == {d for d, found in brute_contaminated(texts, items).items() if not found}
    assert ids["packing"] == ids["decontamination"]
    assert all(r.n_chars == len(r.text) for r in seen["lines"].collect())


def test_stages_bear_edge_rows(spark, edge, empty, small_docs):
    rows = edge.select(*small_docs.columns)
    for name, stage in corpus_pipeline.STAGES:
        for docs in (rows, empty):
            out = stage(spark, docs, SMOKE)
            n = out.count()
            if name != "packing":
                assert out.columns == docs.columns and n <= docs.count()
            elif docs is empty:
                assert n == 0
    kept = {r.doc_id for r in corpus_pipeline.stage_language(spark, rows, SMOKE).collect()}
    assert not kept & {2, 3, 4, 5}


def test_pipeline_runs_and_packs(spark):
    rows = corpus_pipeline.run(spark, SMOKE).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 4096
    assert packing.pack  # the last stage's operator


def test_long_items_are_not_broadcast_whole(spark):
    """Both joins find the same passages of an item of thousands of words."""
    words = [f"w{i}" for i in range(4000)]
    items = spark.createDataFrame([(1, " ".join(words)), (1, "other text under the same id of nine words"), (None, " ".join(words[100:140]))],
                                  "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x y z " + " ".join(words[2000:2020])), (2, " ".join(words[90:150])), (3, "nothing here")],
                                 "doc_id bigint, text string")
    near = D.report(docs, items).orderBy("doc_id").collect()
    far = sorted(D.contaminated(docs, items, broadcast_bytes=100).select("doc_id", "item_id", "surplus").collect(), key=repr)
    assert far == sorted(D.contaminated(docs, items).select("doc_id", "item_id", "surplus").collect(), key=repr)
    assert [(r.doc_id, r.contaminated, r.n_items) for r in near] == [(1, True, 1), (2, True, 1), (3, False, 0)]
