"""Writers and the latest-wins upsert used for stored embeddings, scores and bars."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders of a price table: a ticker's bars lie in one of them, however many tickers there are.
PRICE_BUCKETS = 64
PRICE_BUCKET = "ticker_bucket"


def upsert_latest(existing: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """INSERT OR REPLACE semantics: per key the row with the greatest ``order``
    wins (ties: rows of ``updates`` win).

    Expressed as ``max_by`` in a group-by, so it is a partial aggregate: a key
    with many versions is reduced map-side before the shuffle."""
    a = existing.withColumn("_src", F.lit(0))
    b = updates.withColumn("_src", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    payload = [c for c in both.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order], F.col("_src"))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in payload]), ordering).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in payload if c != "_src"])


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite", dynamic: bool = True) -> None:
    """Snappy Parquet; with ``partition_by`` and ``dynamic`` only the
    partitions present in ``df`` are replaced."""
    w = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        if dynamic:
            w = w.option("partitionOverwriteMode", "dynamic")
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_nonempty(df: DataFrame, path: str, what: str, **kw) -> None:
    """Write, failing like the original when nothing is there to save."""
    if df.isEmpty():
        raise ValueError(f"No {what} to save")
    write_table(df, path, **kw)


def write_sentiment(df: DataFrame, path: str) -> None:
    write_nonempty(df, path, "sentiment results")


def write_news(df: DataFrame, path: str) -> None:
    write_nonempty(df, path, "articles")


def price_bucket(ticker: Column) -> Column:
    """The folder of a ticker's bars."""
    return F.pmod(F.crc32(F.coalesce(ticker, F.lit(""))), F.lit(PRICE_BUCKETS)).cast("int")


def _stored_prices(df: DataFrame, path: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.parquet(path)
    except AnalysisException as failed:
        if failed.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_prices(df: DataFrame, path: str) -> None:
    """One layout serves both 'per ticker' and 'combined' readers: ``PRICE_BUCKETS`` folders of
    tickers, each a file sorted by ticker and date, so a ticker prunes folders and row groups.
    The tickers in ``df`` replace their stored bars, others stay.  (A folder for every ticker
    makes files, renames and listings of their number.)  A table stored with a folder for every
    ticker keeps that layout."""
    stored = _stored_prices(df, path)
    if stored is not None and PRICE_BUCKET not in stored.columns:
        write_table(df, path, partition_by=["ticker"])
        return
    out = df.withColumn(PRICE_BUCKET, price_bucket(F.col("ticker")))
    if stored is not None:
        new = df.select(F.col("ticker").alias("_t")).distinct()
        # at most PRICE_BUCKETS numbers
        touched = [r[0] for r in out.select(PRICE_BUCKET).distinct().collect()]
        others = (stored.filter(F.col(PRICE_BUCKET).isin(touched))
                  .join(new, F.col("ticker").eqNullSafe(F.col("_t")), "left_anti"))
        out = out.unionByName(others, allowMissingColumns=True)
    write_table(out.repartition(PRICE_BUCKET).sortWithinPartitions(PRICE_BUCKET, "ticker", "date"), path,
                partition_by=[PRICE_BUCKET])


def write_filing_index(df: DataFrame, path: str) -> None:
    write_table(df, path, partition_by=["date_filed"])


def write_predictions_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def refresh_prices(existing: DataFrame, recent: DataFrame, derive) -> DataFrame:
    """Replace re-pulled bars and recompute derived columns on the merged
    history (``derive`` e.g. ``operators.prices.with_returns``)."""
    base = [c for c in existing.columns if c in ("ticker", "date", "open", "high", "low", "close", "volume")]
    merged = upsert_latest(existing.select(*base).withColumn("_v", F.lit(0)),
                           recent.select(*base).withColumn("_v", F.lit(1)), ["ticker", "date"], ["_v"])
    return derive(merged.drop("_v"))


def append_price_pull(df: DataFrame, path: str, as_of, version_col: str = "as_of") -> None:
    """Keep a dated copy of a price pull: append it under its own
    ``version_col`` partition (read back with ``operators.prices.prices_as_of``)."""
    (df.withColumn(version_col, F.lit(as_of)).write.mode("append").option("compression", "snappy")
     .partitionBy(version_col).parquet(path))
