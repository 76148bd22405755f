"""The default encoder and the cosines with constant vectors, against plain Python."""

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions.fixed import DEFAULT_LEXICON
from tidemark.functions.models import hash_values, hashed_encoder
from tidemark.functions.text import collapse_ws, count_contained
from tidemark.functions.vectors import cosines_const
from tidemark.operators import aspects as A
from tidemark.operators import novelty as NV

TEXTS = ["Cash flow, cash; FLOW!", "", "  ", None, "straße_1 ÉCLAIR éclair", "a" * 50, "-- x --\n\ty  z "]


def bucket_counts(text, dim):
    out = [0.0] * dim
    for w in re.split(r"[^\w]+", text.lower()):
        if w:
            out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
    return out


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_counted_a_bucket(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r.i: r.v for r in df.select("i", hashed_encoder(F.col("text"), 16).alias("v")).collect()}
    assert got == {i: [None] * 16 if t is None else bucket_counts(t, 16) for i, t in enumerate(TEXTS)}
    # one pass over a text's words, not one a bucket
    wide, narrow = (plan(NV.encode(df, "text", dim=dim)) for dim in (64, 4))
    assert "array_remove" not in wide and len(wide) <= len(narrow) + 20


def test_cosines_with_all_constants_in_one_pass(spark):
    rows = [(0, [1.0, 2.0, 0.0]), (1, [0.0, 0.0, 0.0]), (2, None), (3, [1.0, None, 2.0]), (4, [3.0, -1.0, 0.5])]
    consts = [[1.0, 0.0, 2.0], [0.0, 0.0, 0.0], [0.5, 0.25, 0.0]]
    df = spark.createDataFrame(rows, "i int, v array<double>").repartition(2)

    def cosine(v, c):
        if v is None or None in v or not any(v) or not any(c):
            return 0.0
        return sum(x * y for x, y in zip(v, c)) / (math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(y * y for y in c)))

    for r in df.select("i", cosines_const("v", consts).alias("c")).collect():
        assert all(math.isclose(x, cosine(rows[r.i][1], c), abs_tol=1e-15) for x, c in zip(r.c, consts))
    # the plan does not spell out a product for every component of every aspect's vector
    vectors = {a: [1.0 / (i + k + 1) for i in range(64)] for k, a in enumerate(DEFAULT_LEXICON)}
    texts = spark.createDataFrame([("cash flow",)], "text string")
    found = A.detect_aspects(NV.encode(texts, "text"), "text", DEFAULT_LEXICON, vectors, "embedding", False, True)
    assert len(plan(found)) < 20_000


def test_white_space_runs_become_one_space(spark):
    texts = ["a b", "a  b", " a\t\tb ", "a   b", "a b c", "\n", "", "a\n b \x1c\x85 c  "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i: r.t for r in df.select("i", collapse_ws("t").alias("t")).collect()} == {
        i: " ".join(t.split()) for i, t in enumerate(texts)}


def test_white_space_runs_of_every_kind(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    edges = "\x00\x08\x0e\x1b!~\x7f\x84\x86\x9f\xa1\u200b\u2010\u3001\ufeff\U0001f600"
    texts = [f"a{x}{y}b{x}" for x in spaces for y in [*spaces[:8], "", "c"]] + [f"{e} {e}  {e}" for e in edges]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i: r.t for r in df.select("i", collapse_ws("t").alias("t")).collect()} == {
        i: " ".join(t.split()) for i, t in enumerate(texts)}


def test_hashes_become_numbers_in_arrow_batches(spark):
    digits = ["00000000", "ffffffff", "0123abcd", "9a0f0001", "deadbeef"]
    assert hash_values(pa.array(digits)).tolist() == [int(x, 16) for x in digits]
    assert hash_values(pa.array(digits).slice(1, 3)).tolist() == [int(x, 16) for x in digits[1:4]]
    assert hash_values(pa.array([], pa.string())).tolist() == []
    # no conversion of a word's hash to a number in the plan
    df = spark.createDataFrame([("cash flow",)], "text string")
    assert "conv(" not in plan(NV.encode(df, "text")) and plan(NV.encode(df, "text")).count("md5(") == 1


def test_absent_words_cost_no_instr(spark):
    rows = ["cash flow and a loss", "xcash flowing", "cash  flow", "", None, "against", "straße ÉCLAIR write-down"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    words = ["cash flow", "gain", "loss", "", "éclair", "straße"]
    low = F.lower("t")
    got = {r.i: r.n for r in df.select("i", count_contained(low, words).alias("n")).collect()}
    assert got == {i: sum(t is not None and w in t.lower() for w in words) for i, t in enumerate(rows)}
    # each instr stands behind a contains
    flags = [c.alias(a) for a, c in A.keyword_flags(F.col("t")).items()]
    for found in (df.select(count_contained(low, words[:3]).alias("n")), df.select(*flags)):
        text = plan(found)
        assert text.count("Contains(") == text.count("instr(") > 0
