"""The versioned table and the streams over it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import snapshots
from tidemark.sources.snapshots import SnapshotTable
from tidemark.streaming import dedupe_batch_writer, first_article_writer, stream_dedupe_store, stream_first_articles

ARTICLES = "link string, published_date timestamp"


def articles(spark, rows):
    return spark.createDataFrame([(u, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for u, h in rows], ARTICLES)


def test_an_empty_first_batch_does_not_end_the_stream(spark, tmp_dir):
    for no, rows in enumerate(([("drop", 1)], [("u1", 2)], [("u1", 3), ("u2", 4)])):
        articles(spark, rows).coalesce(1).write.parquet(f"{tmp_dir}/src/p{no}")

    def source():
        return (spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
                .parquet(f"{tmp_dir}/src").where("link <> 'drop'"))
    stream_dedupe_store(source(), f"{tmp_dir}/plain", f"{tmp_dir}/ck1").awaitTermination()
    assert {r.link for r in spark.read.parquet(f"{tmp_dir}/plain").collect()} == {"u1", "u2"}
    stream_first_articles(source(), f"{tmp_dir}/t", f"{tmp_dir}/ck2", buckets=4).awaitTermination()
    table = SnapshotTable(spark, f"{tmp_dir}/t", ["url_hash"])
    assert sorted((r.link, r.published_date.hour) for r in table.read().collect()) == [("u1", 2), ("u2", 4)]
    dedupe_batch_writer(f"{tmp_dir}/none")(articles(spark, [("x", 1)]).limit(0), 0)


def test_a_table_of_empty_batches_reads_as_empty(spark, tmp_dir):
    first_article_writer(f"{tmp_dir}/t", buckets=4)(articles(spark, [("x", 1)]).limit(0), 0)
    got = SnapshotTable(spark, f"{tmp_dir}/t", ["url_hash"]).read()
    assert got.columns == ["link", "published_date", "url_hash"] and got.count() == 0


def test_a_hundred_batches_equal_a_distinct(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_FOLDERS", 3)          # rewrites happen, too
    rng, seen = random.Random(2), {}
    write = first_article_writer(f"{tmp_dir}/t", buckets=3)
    for no in range(100):
        rows = [(f"u{rng.randrange(60)}", no * 10 + i) for i in range(rng.randrange(4))]
        for link, hour in rows:
            seen.setdefault(link, hour)
        write(articles(spark, rows) if rows else articles(spark, [("x", 0)]).limit(0), no)
        if no % 25 == 0:
            write(articles(spark, [("replayed", 1)]), no)      # a batch that is already in changes nothing
    table = SnapshotTable(spark, f"{tmp_dir}/t", ["url_hash"])
    start = dt.datetime(2024, 1, 1)
    got = {r.link: int((r.published_date - start).total_seconds()) // 3600 for r in table.read().collect()}
    assert got == seen
    assert max(map(len, table.manifest()["folders"].values())) <= 4
    assert table.vacuum(keep=1) > 0
    assert {r.link for r in table.read().collect()} == set(seen) and len(table.versions()) == 1


def test_a_stream_begun_anew_goes_on_with_the_table(spark, tmp_dir):
    first_article_writer(f"{tmp_dir}/t", writer="one")(articles(spark, [("a", 1)]), 0)
    first_article_writer(f"{tmp_dir}/t", writer="two")(articles(spark, [("a", 2), ("b", 2)]), 0)
    got = SnapshotTable(spark, f"{tmp_dir}/t", ["url_hash"]).read().collect()
    assert sorted((r.link, r.published_date.hour) for r in got) == [("a", 1), ("b", 2)]


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, tmp_dir):
    table = SnapshotTable(spark, f"{tmp_dir}/t", ["k"], buckets=8)
    table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("v")), ["v"])
    bucket = spark.range(7, 8).select(F.col("id").alias("k")).select(table.bucket_of()).first()[0]
    some = table.read([bucket])
    assert 0 < some.count() < 200 and {f.split("_bucket=")[1].split("/")[0] for f in some.inputFiles()} == {str(bucket)}
    before = table.manifest()["folders"]
    table.upsert(spark.createDataFrame([(7, 5)], "k long, v int"), ["v"])
    after = table.manifest()["folders"]
    assert {b for b in after if after[b] != before[b]} == {str(bucket)}
    assert table.read().where("k = 7").collect() == [(7, 5)] and table.read().count() == 200


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_dir, monkeypatch):
    table = SnapshotTable(spark, f"{tmp_dir}/t", ["k"], buckets=4)
    rows = spark.createDataFrame([(i, 1) for i in range(20)], "k long, v int")
    table.upsert(rows, ["v"], batch_id=0)
    held = table.read()
    boom = F.udf(lambda v: 1 // 0 if v == 13 else v, "int")
    with pytest.raises(Exception):  # noqa: B017 - some buckets are written, one task fails
        table.upsert(rows.withColumn("v", boom("k")), ["v"], batch_id=1)
    assert sorted(map(tuple, table.read().collect())) == [(i, 1) for i in range(20)]
    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost before the switch")))
        with pytest.raises(OSError):
            table.upsert(rows.withColumn("v", F.lit(2)), ["v"], batch_id=1)
    assert {r.v for r in table.read().collect()} == {1}
    table.upsert(rows.withColumn("v", F.lit(2)), ["v"], batch_id=1)
    assert {r.v for r in table.read().collect()} == {2}
    assert {r.v for r in held.collect()} == {1}                 # a reader keeps its version
    assert {r.v for r in table.read(version=0).collect()} == {1}
    table.upsert(rows.withColumn("v", F.lit(3)), ["v"], batch_id=1)
    assert {r.v for r in table.read().collect()} == {2}         # replay


def test_null_keys_and_ties(spark, tmp_dir):
    table = SnapshotTable(spark, f"{tmp_dir}/t", ["k"], buckets=2)
    table.append_first(spark.createDataFrame([(None, 2), (None, 1), (1, 1), (1, 1)], "k long, v int"), ["v"])
    table.append_first(spark.createDataFrame([(None, 0), (2, 9)], "k long, v int"), ["v"])
    assert sorted(map(tuple, table.read().collect()), key=repr) == [(1, 1), (2, 9), (None, 1)]


def test_two_writers_cannot_make_one_version(spark, tmp_dir):
    table = SnapshotTable(spark, f"{tmp_dir}/t", ["k"], buckets=2)
    table.upsert(spark.createDataFrame([(1, 1)], "k long, v int"), ["v"])
    stale = table.manifest()
    table.upsert(spark.createDataFrame([(2, 1)], "k long, v int"), ["v"])
    with pytest.raises(RuntimeError):
        table._add(stale, None, (), "", None)
