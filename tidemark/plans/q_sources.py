"""Source / sink round trips: tables Spark derives from the shared inputs are
written with the library's sinks to a fresh folder under the shared checkpoint
directory and read back with its readers (partition pruning and pushdown on
the way back)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.operators import sentiment as S
from tidemark.plans import inputs as I
from tidemark.plans import sqlparts as P
from tidemark.plans.q_sentiment import SCORED_SQL
from tidemark.plans.q_filings import INDEX_FROM, INDEX_SQL, INDEX_TO, SEGMENT, filing_index_8k
from tidemark.plans.registry import query, rounded
from tidemark.session import scratch_dir
from tidemark.sources import readers as R
from tidemark.sources import sinks as K

BAR_COLS = ["ticker", "date", "open", "high", "low", "close", "volume"]
PRICE_TICKER = "U3"
PRICE_FROM, PRICE_TO = date(2024, 1, 5), date(2024, 1, 20)
FEED_SOURCE = "wire"
FEED_COLLECTED = datetime(2024, 3, 1, 0, 0, 0)

_BARS_OUT = ("ticker, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, "
             "round(close, 6) AS close, volume")


def _written_prices(spark, d) -> str:
    root = scratch_dir(spark, "prices")
    K.write_prices(I.bars_short(spark, d), root)
    return root


@query("roundtrip_prices", f"""WITH {P.BARS_SHORT}
SELECT {_BARS_OUT} FROM bars""")
def roundtrip_prices(spark, d):
    """Bars written by ticker and read back whole."""
    return rounded(R.read_prices(spark, _written_prices(spark, d)).select(*BAR_COLS))


@query("roundtrip_prices_range", f"""WITH {P.BARS_SHORT}
SELECT {_BARS_OUT} FROM bars
WHERE ticker = '{PRICE_TICKER}' AND date BETWEEN DATE '{PRICE_FROM}' AND DATE '{PRICE_TO}'""")
def roundtrip_prices_range(spark, d):
    """One ticker and an inclusive date range read back: the ticker prunes
    partitions, the dates are pushed to the Parquet scan."""
    df = R.read_prices(spark, _written_prices(spark, d), PRICE_TICKER, PRICE_FROM, PRICE_TO)
    return rounded(df.select(*BAR_COLS))


@query("roundtrip_news", f"""WITH {P.FILINGS},
{P.NEWS}
SELECT doc_id, title, summary, link, source, published_date, collected_at, feed_pos FROM news""")
def roundtrip_news(spark, d):
    """Articles saved (an empty batch would be an error) and loaded back."""
    root = scratch_dir(spark, "news")
    K.write_news(I.news(spark, d), root)
    return R.read_news(spark, root).select("doc_id", "title", "summary", "link", "source", "published_date",
                                           "collected_at", "feed_pos")


@query("roundtrip_filing_index", f"""WITH {INDEX_SQL}
SELECT form_type, company_name, cik, date_filed, filename, accession, filing_url FROM idx2
WHERE strpos(form_type, '8-K') > 0 AND date_filed BETWEEN DATE '{INDEX_FROM}' AND DATE '{INDEX_TO}'
  AND isodow(date_filed) < 6
  AND cik IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') FROM customer WHERE c_mktsegment = '{SEGMENT}')""")
def roundtrip_filing_index(spark, d):
    """The 8-K index persisted one folder per filing date and read back."""
    root = scratch_dir(spark, "filing-index")
    K.write_filing_index(filing_index_8k(spark, d), root)
    return R.read_table(spark, root).select("form_type", "company_name", "cik", "date_filed", "filename",
                                            "accession", "filing_url")


@query("roundtrip_feed_items", f"""WITH {P.FILINGS},
{P.NEWS}
SELECT title, coalesce(summary, '') AS summary, link, published_date, '{FEED_SOURCE}' AS source FROM news""")
def roundtrip_feed_items(spark, d):
    """Articles staged as RSS ``<item>`` XML (RFC 822 dates) and read back with
    the feed reader (Spark's XML source)."""
    root = scratch_dir(spark, "feed")
    items = I.news(spark, d).select(
        "title", F.col("summary").alias("description"), "link",
        F.date_format("published_date", "EEE, dd MMM yyyy HH:mm:ss Z").alias("pubDate"))
    items.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(root)
    back = R.read_feed_items(spark, root, FEED_SOURCE, FEED_COLLECTED)
    return back.select("title", "summary", "link", "published_date", "source")


@query("roundtrip_sentiment", f"""{SCORED_SQL}
SELECT doc_id, ticker, date, sentiment_label, round(sentiment_compound, 6) AS sentiment_compound FROM scored""")
def roundtrip_sentiment(spark, d):
    """Per-filing sentiment persisted (nothing scored would be an error) and
    loaded back."""
    root = scratch_dir(spark, "sentiment")
    scored = S.score_sentiment(I.filings(spark, d), "text").select(
        "doc_id", "ticker", "date", "sentiment_label", "sentiment_compound")
    K.write_sentiment(scored, root)
    return rounded(R.read_table(spark, root))
