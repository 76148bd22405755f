"""Domain inputs derived by Spark from the shared test tables.

Every registered query starts from these, so its work grows with the tables:

* ``filings``      documents → (doc_id, ticker, date, text, lang, source); each
                   text is prefixed by one paragraph from a small bank of our
                   own financial sentences (picked by doc_id) so that aspect,
                   polarity, section and ticker logic has something to find.
* ``bars_long``    lineitem → daily OHLCV bars per supplier (~530 bars each).
* ``bars_short``   events → daily bars per user (30 days).
* ``firm_vectors`` embeddings → (ticker, date, embedding) firm texts.
* ``news``         filings → article rows (title = first paragraph, link from
                   md5 of the document text so exact copies collide).
* ``index_lines``  orders → fixed-width company-index lines, grouped in one
                   pseudo file per filing date, with preamble/header/ruler.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.prices import bars_from_trades

# Our own financial sentences (first paragraph of each derived filing).
FILING_BANK = [
    "Item 2.02 Results of Operations and Financial Condition. Revenue growth beat the forecast and "
    "margin gains lifted earnings; AAPL shares rise.",
    "Item 5.02 Departure of Directors. The board announced the resignation of the chief executive "
    "and will appoint an interim president.",
    "Item 1.01 Entry into a Material Definitive Agreement. The company signed a new credit facility "
    "to refinance debt and improve liquidity. Item 9.01 Financial Statements and Exhibits.",
    "Item 8.01 Other Events. Regulatory investigation and litigation uncertainty remain a key risk "
    "factor; analysts downgrade MSFT and shares drop.",
    "Item 7.01 Regulation FD Disclosure. Management expects capacity expansion at the manufacturing "
    "facility after the merger and acquisition close.",
    "Item 2.02 Results. An impairment charge and restructuring cost led to a loss and disappointing "
    "cash flow; the outlook was cut.",
    "Item 1.02 Termination of a Material Definitive Agreement. The loan agreement with JPM was "
    "terminated; borrowing needs fall and working capital improves.",
    "Quarterly guidance was raised as profit and revenue exceed the target; investors buy the rally "
    "in NVDA and V.",
    "A material weakness in compliance controls was disclosed; expense growth and write-down risk "
    "weigh on the bearish view. Taxpayer ID 12-3456789.",
    "The director retired and a successor was appointed; consolidation of operations is anticipated. "
    "Contact SSN 123-45-6789 on file.",
    "No material news today; trading was flat.",
    "Item 8.01 Other Events. The divestiture of the legacy unit is expected to lower financing cost "
    "and support an upgrade by BAC analysts. Item 9.01 Exhibits.",
]

FILING_EPOCH = "1996-01-01"   # first filing date
DOCS_PER_TICKER_DAY = 20      # documents rotate over 20 sources → one doc per ticker per step
DAYS_PER_STEP = 3
NEWS_EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as stored.  ``tidemark.input.partitions`` may ask for so many partitions
    of it, for files of one row group that a scan cannot split (the benchmark's)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = spark.conf.get("tidemark.input.partitions", None)
    return df.repartition(int(wanted)) if wanted else df


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings_from(table(spark, sf_dir, "documents"))


def filings_from(d: DataFrame, *extra) -> DataFrame:
    """The filings projection of a documents frame (batch or streaming), plus
    any ``extra`` columns computed from the raw document row."""
    bank = F.array(*[F.lit(s) for s in FILING_BANK])
    step = F.floor(F.col("doc_id") / DOCS_PER_TICKER_DAY).cast("int") * DAYS_PER_STEP
    return d.select(
        "doc_id",
        F.upper(F.col("source")).alias("ticker"),
        F.date_add(F.lit(FILING_EPOCH).cast("date"), step).alias("date"),
        F.concat(F.element_at(bank, (F.col("doc_id") % len(FILING_BANK) + 1).cast("int")),
                 F.lit("\n\n"), F.col("text")).alias("text"),
        "lang", "source", *extra,
    )


def bars_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return bars_from_trades(
        li,
        ticker=F.concat(F.lit("SRC"), (F.col("l_suppkey") - 1).cast("string")),
        ts=F.col("l_shipdate"),
        price=F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")),
        qty=F.col("l_quantity"),
        seq=F.col("l_orderkey") * 8 + F.col("l_linenumber"),
    )


def bars_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return bars_from_trades(
        ev,
        ticker=F.concat(F.lit("U"), F.col("user_id").cast("string")),
        ts=F.col("ts"), price=F.col("value"), qty=None, seq=F.col("event_id"),
    )


def firm_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return firm_vectors_from(table(spark, sf_dir, "embeddings"))


def firm_vectors_from(e: DataFrame) -> DataFrame:
    """The firm-vector projection of an embeddings frame (batch or streaming)."""
    return e.select(
        "vec_id",
        F.concat(F.lit("F"), F.col("label").cast("string")).alias("ticker"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 60).cast("int")).alias("date"),
        F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("text"),
        "embedding",
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one scan: the link hashes the raw document text, carried alongside
    f = filings_from(table(spark, sf_dir, "documents"), F.md5("text").alias("_h"))
    parts = F.split(F.col("text"), "\n\n", 2)
    return f.select(
        "doc_id",
        F.element_at(parts, 1).alias("title"),
        F.try_element_at(parts, F.lit(2)).alias("summary"),
        F.concat(F.lit("https://news.example/"), F.col("_h")).alias("link"),
        F.col("source"),
        (F.lit(NEWS_EPOCH).cast("timestamp") + F.make_dt_interval(mins=(F.col("doc_id") * 10).cast("int")))
        .alias("published_date"),
        (F.lit(NEWS_EPOCH).cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id").cast("int")))
        .alias("collected_at"),
        F.col("doc_id").alias("feed_pos"),
    )


def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, pos, line) of pseudo company-index files, one per date."""
    o = table(spark, sf_dir, "orders")
    form = (F.when(F.col("o_orderpriority").startswith("1"), "8-K")
            .when(F.col("o_orderpriority").startswith("2"), "8-K/A")
            .when(F.col("o_orderpriority").startswith("3"), "10-K")
            .when(F.col("o_orderpriority").startswith("4"), "10-Q")
            .otherwise("4"))
    ymd = F.date_format(F.col("o_orderdate"), "yyyyMMdd")
    fname = F.concat(F.lit("edgar/data/"), F.col("o_custkey").cast("string"), F.lit("/"),
                     F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-"),
                     F.date_format(F.col("o_orderdate"), "yy"), F.lit("-"),
                     F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit(".txt"))
    line = F.concat(F.rpad(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")), 62, " "),
                    F.rpad(form, 12, " "), F.rpad(F.col("o_custkey").cast("string"), 12, " "),
                    F.rpad(ymd, 12, " "), fname)
    body = o.select(F.concat(F.lit("company."), ymd, F.lit(".idx")).alias("file_path"),
                    F.col("o_orderkey").alias("pos"), line.alias("line"))
    header = ("Company Name".ljust(62) + "Form Type".ljust(12) + "CIK".ljust(12)
              + "Date Filed".ljust(12) + "File Name")
    pre = [(-6, "Description:           Daily Index of EDGAR Dissemination Feed by Company Name"),
           (-5, "Last Data Received:    see file name"), (-4, ""),
           (-3, "Comments:              pseudo index"), (-2, header), (-1, "-" * 130)]
    files = body.select("file_path").distinct()
    extra = files.select("file_path", F.explode(F.array(*[
        F.struct(F.lit(p).cast("bigint").alias("pos"), F.lit(t).alias("line")) for p, t in pre])).alias("_x"))
    return body.unionByName(extra.select("file_path", "_x.pos", "_x.line"))


def ticker_cik(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"),
                    F.col("c_custkey").cast("string").alias("cik"), "c_mktsegment")
