"""Large lexicons: the automaton against one test a term."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.fixed import DEFAULT_LEXICON
from tidemark.operators import aspects as A
from tidemark.operators import terms as T

TEXTS = ["Cash flow from operations; the Gains were against plan.", "Credit facility, liquid assets AND a mer*ger", "", None,
         "restructuring charges\nlayoffs and severance", "ab*c abxc a.b foo bar", "straße ÉCLAIR éclair", "x" * 3000 + "tail"]


def rows(df, col):
    return sorted((r.i, h["aspect"], h["term"]) for r in df.select("i", col.alias("h")).collect() for h in r.h)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")


def unrolled(texts, lexicon):
    low = F.lower(F.coalesce("text", F.lit("")))
    out = []
    for aspect, terms in lexicon.items():
        for t in dict.fromkeys(terms):
            out += [(r.i, aspect, t) for r in texts.where(A.term_match(low, t)).collect()]
    return sorted(out)


def test_same_rows_as_one_test_a_term(spark, texts):
    tricky = {"a": ["cash", "Gain", "liquid*", "Liquid*", "restr*ring", "a*c", "éclair", "ÉCLAIR", "tail"],
              "b": ["cash", "lay*", "x*t", "*", "credit fac*", "[cs]everance*", "", "cash"]}
    assert rows(texts, T.term_hits(F.col("text"), tricky)) == unrolled(texts, tricky)
    assert rows(texts, T.term_hits(F.col("text"), DEFAULT_LEXICON)) == unrolled(texts, DEFAULT_LEXICON)


def test_aspects_equal_the_unrolled_map(spark, texts):
    got = {r.i: r.m for r in texts.select("i", T.keyword_aspects(F.col("text"), DEFAULT_LEXICON).alias("m")).collect()}
    want = {r.i: r.m for r in texts.select("i", A.extract_aspects(F.col("text"), use_semantic=False).alias("m")).collect()}
    assert got == want


def test_ten_thousand_terms(spark, texts):
    """The plan does not grow with the lexicon, and every substring is found, whatever the part size."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeilnorst", k=rng.randrange(2, 6)))
    lexicon = {f"a{k}": [word() for _ in range(1000)] for k in range(10)}
    hits = T.term_hits(F.col("text"), lexicon)
    plan = len(texts.select(hits)._jdf.queryExecution().optimizedPlan().toString())
    few = len(texts.select(T.term_hits(F.col("text"), {"a0": ["x"]}))._jdf.queryExecution().optimizedPlan().toString())
    assert plan <= few + 20
    want = sorted((i, a, t) for i, text in enumerate(TEXTS) for a, terms in lexicon.items() for t in set(terms)
                  if t in (text or "").lower())
    assert rows(texts, hits) == want
    assert len(T.lexicon_parts(lexicon, 20_000)) > 3
    assert rows(texts, T.term_hits(F.col("text"), lexicon, most_bytes=20_000)) == want


def test_a_batch_of_texts_is_answered_in_bounded_pieces():
    pairs = [("a", f"w{i}") for i in range(500)]
    text = " ".join(t for _, t in pairs)
    pieces = list(T._matcher(pairs).func(iter([pa.array([text] * 700 + [None, "w1"])])))
    assert len(pieces) > 2 and all(len(p.flatten()) <= T.MOST_HITS + len(pairs) for p in pieces)
    found = [h for p in pieces for h in p.to_pylist()]
    assert found == [[{"aspect": a, "term": t} for a, t in pairs]] * 700 + [[], [{"aspect": "a", "term": "w1"}]]


def test_lexicons_from_tables_are_bounded(spark):
    table = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), (None, "y"), ("b", "z")], "aspect string, term string")
    assert T.collect_lexicon(table) == {"a": ["x"], "b": ["z"]}
    with pytest.raises(ValueError):
        T.collect_lexicon(table, 10)
    assert rows(spark.createDataFrame([(1, "x")], "i int, text string"), T.term_hits(F.col("text"), {})) == []
