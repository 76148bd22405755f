"""Language identification and toxicity: edge rows, exact filter arithmetic, held-out accuracy."""

import zlib

import numpy as np
from llm_cases import SMOKE, edge, empty, small_docs  # noqa: F401
from pyspark.sql import functions as F

from tidemark.llm import language_id as li
from tidemark.llm import queries as Q
from tidemark.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


def test_normalise():
    text = lambda s: "".join(map(chr, li.normalise(s)))
    assert text("Ab--c  9É") == " ab c é " and text("123 !") == "" and text("") == "" and text("x") == " x "


def test_filter_returns_every_language_of_a_gram_and_few_others():
    rng = np.random.default_rng(1)
    grams = {f"l{i:03d}": rng.integers(0, 2**63, 500).astype(np.uint64) for i in range(70)}     # two mask words
    shared = grams["l000"][:100]
    grams["l069"][:100] = shared
    model = li.LanguageModel.build(grams)
    for lang in ("l000", "l033", "l064", "l069"):
        assert model.hits(grams[lang])[model.languages.index(lang)] == 500
    both = model.hits(shared)
    assert both[0] == 100 and both[69] == 100
    other = model.hits(rng.integers(0, 2**63, 20_000).astype(np.uint64)) / 20_000
    assert np.abs(other - model.false_rate).max() < 0.01


def test_blocks_do_not_change_the_prediction(monkeypatch):
    model = li.LanguageModel.build({"a": li.gram_hashes(li.normalise("abc abd abe " * 3), 3),
                                    "b": li.gram_hashes(li.normalise("xyz xyw xyv " * 3), 3)})
    text = "abc xyz abd abe " * 50
    whole = model.predict(text)
    monkeypatch.setattr(li, "BLOCK_CHARS", 37)
    assert model.predict(text) == whole and whole[0] == "a"


def test_languages_of_edge_rows(spark, edge, empty, small_docs):
    model = li.fit(small_docs)
    rows = li.identify(edge, model).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert 0 <= r.score <= 1 and (r.lang_pred in model.languages or r.lang_pred == "und")
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (2, 3, 4, 5)] == ["und"] * 4 and by[6].lang_pred != "und"
    nothing = li.fit(empty)
    assert nothing.predict("some text") == ("und", 0.0, 0.0)
    assert li.identify(empty, nothing).count() == 0
    assert li.fit(small_docs.withColumn("lang", F.lit(None).cast("string"))).languages == []


def test_language_query_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = Q.QUERIES["op1_language_id"](spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in unseen) >= 0.97 * len(unseen)


def test_subwords_share_buckets_between_spellings():
    bucket, n = tx.subwords(["stupid", "stupidd", "a", ""])
    parts = np.split(bucket, np.cumsum(n)[:-1])
    one = [tx.subwords([w])[0] for w in ("stupid", "stupidd", "a", "")]
    assert all(sorted(a) == sorted(b) for a, b in zip(parts, one))
    assert len(set(parts[0]) & set(parts[1])) >= len(parts[0]) / 2


def toxic_rows(n, seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.integers(5, 120))]
        label = int(i % 3 == 0)
        if label:
            words[int(rng.integers(len(words)))] = str(rng.choice(["zorgling", "quuxtrox"]))
        rows.append((" ".join(words), label))
    return rows


def test_unseen_spellings_score_like_the_word():
    rows = toxic_rows(600, 3)
    model = tx.train([t for t, _ in rows], [y for _, y in rows])
    fresh = toxic_rows(300, 9)
    got = [int(model.score(t, {}) >= 0.5) for t, _ in fresh]
    assert np.mean([g == y for g, (_, y) in zip(got, fresh)]) > 0.95
    assert model.score("abc fed zorglingg hag", {}) > 0.5 > model.score("abc fed cabbage hag", {})


def test_training_without_both_labels():
    assert tx.train([], []).score("x", {}) < 0.5 and tx.train(["a b"], [0]).score("a", {}) < 0.5
    assert tx.train(["a b"] * 3, [1] * 3).score("a", {}) > 0.5
    assert 0 <= tx.train(["", "!"], [0, 1]).score("", {}) <= 1


def test_toxicity_edge_rows(spark, edge, empty):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (6, 0, 0), (None, 0, 1), (9, None, None), (10, 1, 7)],
                                   "doc_id bigint, quality int, toxic int")
    model = tx.fit(edge, labels)
    rows = tx.score(edge, model).collect()
    assert len(rows) == edge.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert tx.score(empty, tx.fit(empty, labels)).count() == 0
    assert tx.score(empty, tx.fit(edge, labels.limit(0))).count() == 0


def test_toxicity_query_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.QUERIES["op2_toxicity"](spark, SF).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in unseen]) > 0.8


def test_toxicity_sample_is_bounded_after_the_join(spark):
    a, b, c = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5][:3]          # ids that may teach
    docs = spark.createDataFrame([(a, f"bad text {i}") for i in range(50)] + [(b, "x" * 300), (c, "fine")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(a, 1), (b, 0), (c, 0)], "doc_id bigint, toxic int")
    rows = tx.training_sample(docs, labels, by_label=(2, 2), most_chars=200).collect()
    assert sorted((r.label, r.text[:3]) for r in rows) == [(0, "fin"), (1, "bad"), (1, "bad")]
