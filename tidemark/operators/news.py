"""News articles: URL de-duplication, per-source caps, recency, ticker tags,
keyword polarity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed import (NEGATIVE_KEYWORDS,
                                      POSITIVE_KEYWORDS, TARGET_TICKERS)
from tidemark.functions.text import NON_WORD, concat_text, count_contained


def with_url_hash(df: DataFrame, link_col: str = "link") -> DataFrame:
    """md5 of the link; every empty link hashes alike (so only one survives)."""
    return df.withColumn("url_hash", F.md5(F.coalesce(F.col(link_col), F.lit(""))))


def first_seen(df: DataFrame, key: str = "url_hash",
               order: tuple = ("collected_at", "feed_pos")) -> DataFrame:
    """Keep the first row per key by ``order``.

    Written as ``min_by`` over a struct so the choice is a partial aggregate:
    a key holding a large share of the rows is reduced map-side rather than
    sorted inside one window partition."""
    payload = [c for c in df.columns if c != key]
    ordering = F.struct(*[F.col(c) for c in order])
    best = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in payload]), ordering).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) if c != key else F.col(key) for c in df.columns])


def cap_per_source(df: DataFrame, n: int, source_col: str = "source",
                   order: tuple = ("feed_pos", "url_hash")) -> DataFrame:
    """First ``n`` rows of each source in feed order.

    ``row_number() <= n`` lets the optimizer insert a partial per-partition
    group limit before the shuffle, so each source ships at most ``n`` rows per
    map task however large it is."""
    w = Window.partitionBy(source_col).orderBy(*[F.col(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def recent(df: DataFrame, now: datetime, days_back: int, ts_col: str = "published_date") -> DataFrame:
    """Rows published at or after ``now - days_back``; ``now`` is an argument so
    results are reproducible.  ``days_back <= 0`` keeps everything."""
    if days_back <= 0:
        return df
    cutoff = F.lit(now) - F.make_dt_interval(days=F.lit(days_back))
    return df.filter(F.col(ts_col) >= cutoff)


def ticker_mentions(text: Column, tickers: list[str] = TARGET_TICKERS) -> Column:
    """Distinct allow-listed tickers appearing as whole words (case sensitive),
    sorted."""
    words = F.split(text, NON_WORD)
    return F.array_sort(F.array_intersect(words, F.array(*[F.lit(t) for t in tickers])))


def associate_tickers(df: DataFrame, tickers: list[str] = TARGET_TICKERS) -> DataFrame:
    """``tickers`` and ``ticker_count`` from title + ' ' + summary."""
    text = concat_text(F.col("title"), F.col("summary"))
    return (df.withColumn("tickers", ticker_mentions(text, tickers))
              .withColumn("ticker_count", F.size("tickers")))


def article_ticker_rows(df: DataFrame) -> DataFrame:
    """One row per (article, mentioned ticker)."""
    return df.withColumn("ticker", F.explode("tickers"))


def keyword_polarity(df: DataFrame, positive: list[str] | None = None,
                     negative: list[str] | None = None, text: Column | None = None) -> DataFrame:
    """Count distinct positive / negative keywords contained (as substrings) in
    lower-cased title + ' ' + summary; more positives → 'positive', more
    negatives → 'negative', otherwise 'neutral'."""
    pos = POSITIVE_KEYWORDS if positive is None else positive
    neg = NEGATIVE_KEYWORDS if negative is None else negative
    low = F.lower(text if text is not None else concat_text(F.col("title"), F.col("summary")))
    out = df.withColumn("_plow", low)
    out = out.withColumns({"positive_count": count_contained(F.col("_plow"), pos),
                           "negative_count": count_contained(F.col("_plow"), neg)}).drop("_plow")
    return out.withColumn(
        "polarity",
        F.when(F.col("positive_count") > F.col("negative_count"), F.lit("positive"))
         .when(F.col("negative_count") > F.col("positive_count"), F.lit("negative"))
         .otherwise(F.lit("neutral")))


def split_by_polarity(df: DataFrame) -> dict[str, DataFrame]:
    """The three lists of the polarity split as filtered views of one table."""
    scored = df if "polarity" in df.columns else keyword_polarity(df)
    return {p: scored.filter(F.col("polarity") == p) for p in ("positive", "negative", "neutral")}
