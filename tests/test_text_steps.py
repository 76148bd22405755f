"""Text steps that run once a text, whatever consumes them."""

import re

from pyspark.sql import functions as F

from tidemark.functions.plan import materialize
from tidemark.operators import filings as FI
from tidemark.operators import sentiment as S

TEXTS = ["SSN 123-45-6789 and 12-3456789, mail a.b@c.org.", "1-23-4567 x@y 123-45-67890", "", None, "-12- 3-1234567 @",
         "_123-45-6789 (987-65-4321)\nq%r@s-t.example; 99-1234567"]


def test_personal_data_is_looked_for_once(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    found = FI.pii_alerts(df, ["i"])
    want = sorted((i, k, m) for i, t in enumerate(TEXTS) for k, p in FI.PII_PATTERNS.items()
                  for m in re.findall(FI._EDGE_L + p + FI._EDGE_R, t or ""))
    assert len(want) == 6 and sorted(tuple(r) for r in found.collect()) == want
    # an inferred filter on the exploded array would run every pattern a second time
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(FI.PII_PATTERNS)


def test_trigrams_are_dealt_once(spark):
    df = spark.createDataFrame([(1, "a b c a b c"), (1, "a b c"), (2, "x a b c"), (None, "a b c"), (3, None)], "i int, text string")
    out = FI.trigram_tfidf(df, "i", "text")
    assert {(r.i, r.gram): (r.tf, r.df) for r in out.collect()} == {
        (1, "a b c"): (3, 3), (1, "b c a"): (1, 1), (1, "c a b"): (1, 1), (2, "x a b"): (1, 1), (2, "a b c"): (1, 3),
        (None, "a b c"): (1, 3)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(i" not in plan


def test_median_rows_are_computed_once(spark):
    """The values of a median may come from a scorer over whole texts: nothing of it is left in the result's plan."""
    rows = spark.createDataFrame([("2024-01-01", "ab"), ("2024-01-01", "abcd"), ("2024-01-02", None), (None, "x")], "date string, t string")
    scored = materialize(rows, v=F.length("t").cast("double"))
    got = S.sentiment_time_series(scored, "date", "v", "median")
    assert sorted((r.date, r.v) for r in got.collect()) == [("2024-01-01", 3.0), ("2024-01-02", None)]
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
