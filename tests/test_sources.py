"""Source / sink round trips on small fixtures written to a fresh folder."""

import hashlib
import os
from datetime import date, datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.operators import prices as PR
from tidemark.sources import readers as R
from tidemark.sources import sinks as K
from tidemark.streaming import stream_filings


def _write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as fh:
        fh.write(text)


def test_filing_corpus_whole_files_and_keys(spark, tmp_dir):
    _write(f"{tmp_dir}/corpus/320193/0000320193-24-000001.txt", "line one\nline two\n")
    _write(f"{tmp_dir}/corpus/789019/sub/0000789019-24-000002.txt", "other")
    _write(f"{tmp_dir}/corpus/789019/notes.md", "skip me")
    rows = {r.accession: r for r in R.read_filing_corpus(spark, f"{tmp_dir}/corpus").collect()}
    assert set(rows) == {"0000320193-24-000001", "0000789019-24-000002"}
    assert rows["0000320193-24-000001"].raw == "line one\nline two\n"   # whole file, one row
    assert rows["0000320193-24-000001"].cik == "0000320193"


def test_stream_filings_reads_only_new_files(spark, tmp_dir):
    src, out, ck = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    _write(f"{src}/1/a-1.txt", "first")

    def drain():
        q = (stream_filings(spark, src).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination(120)

    drain()
    _write(f"{src}/1/a-2.txt", "second")
    drain()
    got = sorted(r.accession for r in spark.read.parquet(out).collect())
    assert got == ["a-1", "a-2"]          # each file exactly once across runs


def test_files_are_listed_and_read_by_tasks(spark, tmp_dir):
    for i, at in enumerate(["1/a b%é#?x.txt", "2/sub/deep/r.txt", "2/_a=1/x.txt", "_metadata/y.txt", "top.txt",
                            "_hidden/c.txt", "2/_h.txt", "2/.g.txt", "2/n.md", "2/_metadata_x.txt"]):
        _write(f"{tmp_dir}/in/{at}", f"text {i}")
    _write(f"{tmp_dir}/in/2/empty.txt", "")
    found = R.whole_files(spark, f"{tmp_dir}/in", "*.txt")
    plain = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
             .load(f"{tmp_dir}/in").select("path", F.col("_metadata.file_path").alias("file_path"), "length", "content"))
    assert sorted(found.collect()) == sorted(plain.collect()) and found.count() == 5
    # the driver knows none of the files
    assert plain.inputFiles() and not found.inputFiles()
    assert not R.read_filing_corpus(spark, f"{tmp_dir}/in").inputFiles()
    assert not R.file_fingerprints(spark, f"{tmp_dir}/in").inputFiles()
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        R.whole_files(spark, f"{tmp_dir}/none")
    assert R.whole_files(spark, f"{tmp_dir}/in/top.txt").count() == 1
    assert R.whole_files(spark, f"{tmp_dir}/in/2", "[mn].md").count() == 1


def test_stream_of_many_files_takes_few_tasks(spark, tmp_dir):
    for i in range(320):                                  # ten scan partitions of 32 files
        _write(f"{tmp_dir}/in/{i % 3}/a-{i}.txt", f"text {i}")
    q = (stream_filings(spark, f"{tmp_dir}/in").writeStream.format("parquet").option("path", f"{tmp_dir}/out")
         .option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_dir}/out")
    assert sorted((r.accession, r.raw) for r in got.collect()) == sorted((f"a-{i}", f"text {i}") for i in range(320))
    assert len(got.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_index_files_bind_columns_by_header(spark, tmp_dir):
    from tidemark.operators import filings as FI
    header = "Company Name".ljust(62) + "Form Type".ljust(12) + "CIK".ljust(12) + "Date Filed".ljust(12) + "File Name"
    line = ("Apple Inc".ljust(62) + "8-K".ljust(12) + "320193".ljust(12) + "20240102".ljust(12)
            + "edgar/data/320193/0000320193-24-000001.txt")
    _write(f"{tmp_dir}/idx/company.20240102.idx", "\n".join(["Description: x", "", header, "-" * 130, line, ""]))
    lines = R.read_index_files(spark, f"{tmp_dir}/idx")
    rows = FI.parse_index_lines(lines).collect()
    assert len(rows) == 1
    r = rows[0].asDict()
    assert r["company_name"] == "Apple Inc" and r["form_type"] == "8-K" and r["cik_raw"] == "320193"
    assert r["date_raw"] == "20240102" and r["filename"].endswith("0000320193-24-000001.txt")
    # the one-pass whole-file parser gives the same rows without a shuffle
    whole = R.read_filing_index(spark, f"{tmp_dir}/idx")
    assert [x.asDict() for x in whole.collect()] == [x.asDict() for x in rows]
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()


def test_lexicon_round_trip(spark, tmp_dir):
    lex = {"liquidity": ["liquid*", "credit facility"], "risk": ["risk"]}
    R.write_lexicon(spark, lex, f"{tmp_dir}/lex")
    got = sorted((r.aspect, r.term) for r in R.read_lexicon(spark, f"{tmp_dir}/lex").collect())
    assert got == sorted((a, t) for a, ts in lex.items() for t in ts)


def test_fingerprints_equal_hashlib(spark, tmp_dir):
    _write(f"{tmp_dir}/fp/a.txt", "alpha")
    _write(f"{tmp_dir}/fp/b/c.txt", "beta gamma")
    got = {os.path.basename(r.path): r.sha256 for r in R.file_fingerprints(spark, f"{tmp_dir}/fp").collect()}
    assert got == {"a.txt": hashlib.sha256(b"alpha").hexdigest(), "c.txt": hashlib.sha256(b"beta gamma").hexdigest()}


def test_feed_items_defaults(spark, tmp_dir):
    xml = ("<rss><channel>"
           "<item><title>AAPL rises</title><link>http://x/1</link>"
           "<pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate></item>"
           "<item><title>No date</title></item>"
           "</channel></rss>")
    _write(f"{tmp_dir}/feed/f.xml", xml)
    when = datetime(2024, 1, 5, 8, 0, 0)
    rows = R.read_feed_items(spark, f"{tmp_dir}/feed/f.xml", "wire", when).orderBy("feed_pos").collect()
    assert [r.title for r in rows] == ["AAPL rises", "No date"]
    assert rows[1].summary == "" and rows[1].link == ""
    assert rows[0].published_date == datetime(2024, 1, 2, 10, 0, 0)
    assert rows[1].published_date == when            # falls back to collection time


def test_empty_news_batch_is_an_error(spark, tmp_dir):
    empty = spark.createDataFrame([], "link string, title string")
    with pytest.raises(Exception):
        K.write_news(empty, f"{tmp_dir}/news")


def test_predictions_csv_has_header(spark, tmp_dir):
    df = spark.createDataFrame([("AAPL", 0.01)], "ticker string, predicted_return double")
    K.write_predictions_csv(df, f"{tmp_dir}/pred")
    back = spark.read.option("header", True).csv(f"{tmp_dir}/pred").collect()
    assert [tuple(r) for r in back] == [("AAPL", "0.01")]


def test_prices_partitioned_by_ticker_prune(spark, tmp_dir):
    bars = spark.createDataFrame([("A", date(2024, 1, d), 1.0, 1.0, 1.0, 1.0, 1) for d in (1, 2, 3)]
                                 + [("B", date(2024, 1, 2), 2.0, 2.0, 2.0, 2.0, 1)],
                                 "ticker string, date date, open double, high double, low double, close double, volume long")
    K.write_prices(bars, f"{tmp_dir}/px")
    df = R.read_prices(spark, f"{tmp_dir}/px", "A", date(2024, 1, 2), date(2024, 1, 3))
    assert sorted(r.date.day for r in df.collect()) == [2, 3]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ticker" in plan and "PushedFilters" in plan


def test_price_folders_do_not_grow_with_the_tickers(spark, tmp_dir):
    cols = "ticker string, date date, open double, high double, low double, close double, volume long"
    bar = lambda t, day, x: (t, date(2024, 1, day), x, x, x, x, 1)
    first = [bar(f"T{i}", day, float(i)) for i in range(300) for day in (1, 2)] + [bar(None, 1, 5.0), bar("007", 1, 7.0)]
    K.write_prices(spark.createDataFrame(first, cols), f"{tmp_dir}/px")
    assert sum(n.startswith("ticker") for n in os.listdir(f"{tmp_dir}/px")) <= K.PRICE_BUCKETS < 300
    read = lambda *a: sorted(map(repr, R.read_prices(spark, f"{tmp_dir}/px", *a).select(*[c.split()[0] for c in cols.split(", ")]).collect()))
    assert read() == sorted(map(repr, spark.createDataFrame(first, cols).collect()))
    assert len(read("T17")) == 2 and len(read("007")) == 1
    # the tickers written again are replaced, the others stay
    K.write_prices(spark.createDataFrame([bar("T17", 9, 1.5), bar(None, 9, 2.5)], cols), f"{tmp_dir}/px")
    kept = [r for r in first if r[0] not in ("T17", None)] + [bar("T17", 9, 1.5), bar(None, 9, 2.5)]
    assert read() == sorted(map(repr, spark.createDataFrame(kept, cols).collect()))


def test_price_pulls_as_of(spark, tmp_dir):
    cols = "ticker string, date date, close double"
    K.append_price_pull(spark.createDataFrame([("A", date(2024, 1, 1), 10.0)], cols),
                        f"{tmp_dir}/pulls", datetime(2024, 1, 1, 12))
    K.append_price_pull(spark.createDataFrame([("A", date(2024, 1, 1), 11.0), ("A", date(2024, 1, 2), 5.0)], cols),
                        f"{tmp_dir}/pulls", datetime(2024, 1, 2, 12))
    pulls = spark.read.parquet(f"{tmp_dir}/pulls")
    early = PR.prices_as_of(pulls, datetime(2024, 1, 1, 18))
    late = PR.prices_as_of(pulls, datetime(2024, 1, 3))
    assert [(r.date.day, r.close) for r in early.collect()] == [(1, 10.0)]
    assert sorted((r.date.day, r.close) for r in late.collect()) == [(1, 11.0), (2, 5.0)]
    assert "PartitionFilters" in early._jdf.queryExecution().executedPlan().toString()


def test_upsert_batch_writer_is_idempotent_and_latest_wins(spark, tmp_dir):
    from tidemark.streaming import upsert_batch_writer
    cols = "ticker string, date date, created long, score double"
    write = upsert_batch_writer(f"{tmp_dir}/tbl", ["ticker", "date"], ["created"])
    b0 = spark.createDataFrame([("A", date(2024, 1, 1), 1, 0.1), ("A", date(2024, 1, 2), 1, 0.2)], cols)
    b1 = spark.createDataFrame([("A", date(2024, 1, 2), 2, 0.9), ("B", date(2024, 1, 2), 2, 0.5)], cols)
    write(b0, 0)
    write(b1, 1)
    first = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_dir}/tbl").select("ticker", "date", "score").collect())
    write(b1, 1)                        # replay after a failure
    again = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_dir}/tbl").select("ticker", "date", "score").collect())
    assert first == again == [("A", date(2024, 1, 1), 0.1), ("A", date(2024, 1, 2), 0.9), ("B", date(2024, 1, 2), 0.5)]
