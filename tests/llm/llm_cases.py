"""Shared rows and fixtures of these tests."""

import pytest

SMOKE = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))

#: (doc_id, text, lang, source, n_chars) rows with the cases every operator has to bear.
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog.\nA second line of plain words here.", "en", "a", 1),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "en", "b", 4),
    (5, "123 456 -- !!", "en", "b", 4),
    (6, "x", "en", "b", 1),
    (7, "The quick brown fox jumps over the lazy dog.\nA second line of plain words here.", "en", "a", 1),
    (7, "The quick brown fox jumps over the lazy dog.\nA second line of plain words here.", "en", "a", 1),
    (None, "The quick brown fox jumps over the lazy dog.\nA second line of plain words here.", "en", None, 1),
    (None, None, None, None, None),
    (9, LONG, "en", "a", len(LONG)),
    (10, LONG + " tail", "en", "a", len(LONG)),
    (11, "é" * 70_000, "fr", "a", 70_000),
    (-5, "Tabs\tand\x0bvertical\x0cfeeds\r\nand nbsp here  double", "en", "a", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows, with extra columns whose names clash with those used inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, SCHEMA)
    for name in ("n", "score", "line", "no", "doc", "word", "token", "group", "rep", "length", "piece", "_text",
                 "component", "node", "wanted", "spans", "k1", "k2", "items", "item_id", "host", "path"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMOKE}/documents.parquet")
