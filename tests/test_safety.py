"""Caps, switches and failures: order keys, scratch folders, stored tables, streams."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import SMOKE
from tidemark import session
from tidemark.operators import prices as PR
from tidemark.plans import inputs as I
from tidemark.plans import q_streaming as QS
from tidemark.streaming import dedupe_batch_writer, read_if_there, stream_dedupe_store, upsert_batch_writer


def test_large_order_keys_build_the_same_bars(spark):
    """Order keys beyond 1e11 (sequences beyond 1e12) still order the trades of a day."""
    big = 200_000_000_000
    li = spark.read.parquet(f"{SMOKE}/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") + big)
    got = {(r.ticker, r.date): (r.open, r.close) for r in PR.bars_from_trades(
        li, F.col("l_suppkey").cast("string"), F.col("l_shipdate"), F.col("l_extendedprice"), None,
        F.col("l_orderkey") * 8 + F.col("l_linenumber")).collect()}
    want = duckdb.sql(f"""SELECT l_suppkey::VARCHAR, l_shipdate::DATE,
        first(l_extendedprice ORDER BY l_shipdate, (l_orderkey + {big}) * 8 + l_linenumber),
        last(l_extendedprice ORDER BY l_shipdate, (l_orderkey + {big}) * 8 + l_linenumber)
        FROM '{SMOKE}/lineitem.parquet' GROUP BY ALL""").fetchall()
    assert got == {(t, d): (a, b) for t, d, a, b in want}


def test_order_key_covers_every_bigint(spark):
    rows = [(t, s) for t in ("1900-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00.000001", "9999-12-31 00:00:00")
            for s in (-2**63, -1, 0, 2**63 - 1)]
    df = spark.createDataFrame(rows, "t string, s bigint").select(
        F.col("t").cast("timestamp").alias("t"), "s", PR.trade_order_key(F.col("t").cast("timestamp"), F.col("s")).alias("k"))
    keys = [r.k for r in df.orderBy("t", "s").collect()]
    assert None not in keys and keys == sorted(set(keys))


@pytest.mark.parametrize("master,fine", [("local", True), ("local[4]", True), ("local[*]", True), ("yarn", False),
                                         ("spark://h:7077", False), ("k8s://h", False), ("local-cluster[2,1,1024]", False)])
def test_only_a_local_master_gets_a_private_folder(master, fine):
    if fine:
        assert os.path.isdir(session.private_folder(master))
    else:
        with pytest.raises(RuntimeError):
            session.private_folder(master)


def upserts(spark, path, *batches):
    write = upsert_batch_writer(path, ["k"], ["v"])
    for no, rows in enumerate(batches):
        write(spark.createDataFrame(rows, "k string, v int, date date"), no)


def test_upsert_keeps_the_table_when_reading_fails(spark, tmp_dir, monkeypatch):
    day = dt.date(2024, 1, 1)
    path = f"{tmp_dir}/t"
    upserts(spark, path, [("a", 1, day), ("b", 1, day)])
    before = sorted(map(tuple, spark.read.parquet(path).collect()))
    bad = [f for d, _, fs in os.walk(path) for f in [os.path.join(d, x) for x in fs] if f.endswith(".parquet")]
    kept = {f: open(f, "rb").read() for f in bad}
    for f in bad:
        with open(f, "wb") as out:
            out.write(b"not parquet at all")
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.unlink(crc)
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader raises
        upserts(spark, path, [("a", 2, day)])
    for f, content in kept.items():
        assert os.path.exists(f)
        with open(f, "wb") as out:
            out.write(content)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == before
    upserts(spark, path, [("a", 2, day)], [("c", 1, dt.date(2024, 1, 2))])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1), ("c", 1)]


def test_only_a_missing_path_counts_as_no_table(spark, tmp_dir):
    assert read_if_there(spark, f"{tmp_dir}/none") is None
    os.mkdir(f"{tmp_dir}/hollow")
    with pytest.raises(AnalysisException):
        read_if_there(spark, f"{tmp_dir}/hollow")


def test_dedupe_store_drops_copies_however_far_apart(spark, tmp_dir):
    rows = [("u1", "2024-01-01"), ("u2", "2024-01-02"), ("u1", "2024-03-01"), ("u3", "2024-03-02"), ("u2", "2024-06-01"),
            ("u4", "2024-06-02"), ("u4", "2024-06-03")]
    schema = "link string, published_date timestamp"
    for no, (link, day) in enumerate(rows):
        spark.createDataFrame([(link, dt.datetime.fromisoformat(day))], schema).coalesce(1).write.parquet(
            f"{tmp_dir}/src/p{no:02d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(f"{tmp_dir}/src")
    stream_dedupe_store(source, f"{tmp_dir}/t", f"{tmp_dir}/ck").awaitTermination()
    got = sorted((r.link, r.published_date.date().isoformat()) for r in spark.read.parquet(f"{tmp_dir}/t").collect())
    assert got == [("u1", "2024-01-01"), ("u2", "2024-01-02"), ("u3", "2024-03-02"), ("u4", "2024-06-02")]
    # a replayed batch changes nothing
    dedupe_batch_writer(f"{tmp_dir}/t")(spark.createDataFrame([("u1", dt.datetime(2024, 1, 1))], schema), 0)
    assert spark.read.parquet(f"{tmp_dir}/t").count() == 4


@pytest.mark.parametrize("name", ["stream_latest_vectors", "stream_dedupe_news", "stream_sentiment_daily"])
def test_streams_read_folder_tables(spark, tmp_dir, name):
    """A table stored as part files gives the stream the same rows as one file."""
    for t in ("embeddings", "documents"):
        spark.read.parquet(f"{SMOKE}/{t}.parquet").repartition(3).write.parquet(f"{tmp_dir}/{t}.parquet")
    fn = QS.STREAM_QUERIES[name][0]
    one, many = fn(spark, SMOKE), fn(spark, tmp_dir)
    assert one.count() > 0
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))


def test_input_partitions_are_asked_for_not_guessed(spark):
    assert "Exchange" not in I.table(spark, SMOKE, "documents")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("tidemark.input.partitions", "3")
    try:
        assert I.table(spark, SMOKE, "documents").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset("tidemark.input.partitions")


def test_ranked_equals_window_functions(spark):
    import random

    from pyspark.sql import Window

    from tidemark.operators.ranks import ntile, ranked

    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 5}", rng.randint(0, 50), i) for i in range(900)] + [(None, 1, 5000), (None, 0, 5001)]
    df = spark.createDataFrame(rows, "g string, v int, k int")
    w = Window.partitionBy("g").orderBy("v", "k")
    want = {tuple(r) for r in df.select("g", "v", "k", F.row_number().over(w), F.count("k").over(Window.partitionBy("g")),
                                        F.ntile(10).over(w)).collect()}
    got = ranked(df, ["g"], [F.col("v"), F.col("k")]).withColumn("t", ntile(F.col("_rank"), F.col("_size"), 10))
    assert {tuple(r) for r in got.select("g", "v", "k", "_rank", "_size", "t").collect()} == want


def test_panel_with_several_factors_equals_dummies(spark):
    import numpy as np

    from tidemark.operators import models as M

    rng = np.random.default_rng(5)
    rows = [(f"f{e}", t, *map(float, rng.normal(size=2))) for e in range(7) for t in range(9) if rng.random() < 0.8]
    rows = [(e, t, a * 1e-4, b * 1e3, 2e2 * a * 1e-4 - 3e-5 * b * 1e3 + 0.1 * t + float(rng.normal()) * 0.01) for e, t, a, b in rows]
    df = spark.createDataFrame(rows, "ticker string, date int, a double, b double, y double")
    fit = M.panel_fit(df, "y", ["a", "b"])
    x = np.array([[r[2], r[3], *[r[0] == f"f{e}" for e in range(7)], *[r[1] == t for t in range(1, 9)]] for r in rows], float)
    beta = np.linalg.lstsq(x, np.array([r[4] for r in rows]), rcond=None)[0]
    assert np.allclose(fit["slopes"], beta[:2], rtol=1e-6) and fit["rank"] == 2 and fit["n_obs"] == len(rows)
    frame = M.panel_coefficients(df, "y", ["a", "b"]).collect()
    assert [r.term for r in frame] == ["a", "b"] and all(r.cluster_se > 0 for r in frame)
    with pytest.raises(RuntimeError):
        M.panel_fit(df, "y", ["a", "b"], tol=0.0, most_rounds=1)
    assert M.panel_fit(df.limit(0), "y", ["a"])["n_obs"] == 0


def test_ols_keeps_digits_and_names_bad_fits(spark):
    import numpy as np

    from tidemark.operators import models as M

    rng = np.random.default_rng(1)
    rows = [(1e8 + float(a), float(b), 3 * float(a) - 2 * float(b) + 5) for a, b in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = M.fit_ols(df, ["a", "b"], "y")
    assert np.allclose(model.coefficients[1:], [3, -2], rtol=1e-5)
    for bad, features in ((df.limit(0), ["a", "b"]), (df.limit(0), ["a"]), (df.withColumn("a", F.lit(1.0)), ["a"])):
        with pytest.raises(ValueError):
            M.fit_ols(bad, features, "y")
