"""Daily price bars: cleaning, returns, volatility, technical indicators.

All windows are partitioned by ticker and ordered by date, so the combined
multi-ticker table is processed in one pass and never bleeds across tickers.
Bars per ticker are bounded by the trading calendar, so no window partition
can grow with the number of tickers.  Rolling statistics follow the pandas
rule "a full window of non-null values or NULL".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed import RETURN_PERIODS, SMA_WINDOWS, TRADING_DAYS_PER_YEAR

REQUIRED_PRICE_COLUMNS = ["date", "open", "high", "low", "close", "volume"]


def _by_ticker(key: str = "ticker", order: str = "date"):
    return Window.partitionBy(key).orderBy(order)


def rolling(fn, c: Column, n: int, key: str = "ticker", order: str = "date") -> Column:
    """``fn(c)`` over the last ``n`` rows, NULL unless all ``n`` values are non-null."""
    w = _by_ticker(key, order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, fn(c).over(w))


def normalise_columns(df: DataFrame, required=REQUIRED_PRICE_COLUMNS) -> DataFrame:
    """Lower-case column names, spaces to underscores; fail at analysis time
    when a required column is missing."""
    out = df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"Missing required column: {missing[0]}")
    return out


def clean_prices(df: DataFrame) -> DataFrame:
    """Drop bars with a missing price, a non-positive price, high < low or a
    negative volume (a NULL volume fails the test too)."""
    ohlc = ["open", "high", "low", "close"]
    cond = F.col("high") >= F.col("low")
    for c in ohlc:
        cond = cond & (F.col(c) > 0)
    return df.na.drop(subset=ohlc).filter(cond & (F.col("volume") >= 0))


def with_returns(df: DataFrame, key: str = "ticker") -> DataFrame:
    """return_1d, return_1d_fwd and annualised 20-bar volatility."""
    w = _by_ticker(key)
    r = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1
    out = df.withColumn("return_1d", r)
    out = out.withColumn("return_1d_fwd", F.lead("return_1d", 1).over(w))
    return out.withColumn(
        "volatility_20d",
        rolling(F.stddev_samp, F.col("return_1d"), 20, key) * F.lit(math.sqrt(TRADING_DAYS_PER_YEAR)))


def calculate_returns(df: DataFrame, price_col: str = "close",
                      periods=RETURN_PERIODS, key: str = "ticker") -> DataFrame:
    """p-bar percentage change (after forward-filling the price) and its p-bar lead."""
    w = _by_ticker(key)
    filled = F.last(F.col(price_col), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_px", filled)
    for p in periods:
        out = out.withColumn(f"return_{p}d", F.try_divide(F.col("_px"), F.lag("_px", p).over(w)) - 1)
        out = out.withColumn(f"return_{p}d_fwd", F.lead(f"return_{p}d", p).over(w))
    return out.drop("_px")


def technical_indicators(df: DataFrame, key: str = "ticker") -> DataFrame:
    """SMA 5/10/20/50 and distance, Bollinger(20, 2), RSI(14, simple means),
    volume SMA 20 and ratio.  Divisions by zero give NULL."""
    w = _by_ticker(key)
    close = F.col("close")
    cols = {}
    for n in SMA_WINDOWS:
        sma = rolling(F.avg, close, n, key)
        cols[f"sma_{n}"] = sma
        cols[f"close_vs_sma_{n}"] = F.try_divide(close, sma) - 1
    out = df.withColumns(cols)
    bb_std = rolling(F.stddev_samp, close, 20, key)
    out = out.withColumn("bb_middle", rolling(F.avg, close, 20, key))
    out = out.withColumn("bb_upper", F.col("bb_middle") + bb_std * 2)
    out = out.withColumn("bb_lower", F.col("bb_middle") - bb_std * 2)
    out = out.withColumn("bb_position", F.try_divide(close - F.col("bb_lower"),
                                                      F.col("bb_upper") - F.col("bb_lower")))
    # the first bar has no change; it counts as a zero gain and a zero loss
    delta = F.coalesce(close - F.lag(close).over(w), F.lit(0.0))
    out = out.withColumn("_gain", F.when(delta > 0, delta).otherwise(F.lit(0.0)))
    out = out.withColumn("_loss", F.when(delta < 0, -delta).otherwise(F.lit(0.0)))
    gain = rolling(F.avg, F.col("_gain"), 14, key)
    loss = rolling(F.avg, F.col("_loss"), 14, key)
    rsi = (F.when((loss == 0) & (gain > 0), F.lit(100.0))
           .otherwise(F.lit(100.0) - F.try_divide(F.lit(100.0), F.lit(1.0) + F.try_divide(gain, loss))))
    out = out.withColumn("rsi", rsi).drop("_gain", "_loss")
    vol = F.col("volume").cast("double")
    out = out.withColumn("volume_sma_20", rolling(F.avg, vol, 20, key))
    return out.withColumn("volume_ratio", F.try_divide(vol, F.col("volume_sma_20")))


def latest_per_ticker(df: DataFrame, cols=("close", "return_1d", "volatility_20d"),
                      key: str = "ticker") -> DataFrame:
    """Last bar's values per ticker plus coverage (rows, first and last date).

    ``max_by`` is a partial aggregate, so a ticker with a huge history is
    reduced map-side before the shuffle."""
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col("date"))
    out = df.groupBy(key).agg(last.alias("_last"), F.count(F.lit(1)).alias("rows"),
                              F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return out.select(key, "rows", "first_date", "last_date",
                      *[F.col(f"_last.{c}").alias(f"latest_{c}") for c in cols])


def requested_vs_found(requested: DataFrame, found: DataFrame, key: str = "ticker") -> DataFrame:
    """Requested tickers with a ``found`` flag (left-semi/anti in one left join
    against the distinct found keys)."""
    have = found.select(key).distinct().withColumn("found", F.lit(True))
    return (requested.select(key).distinct().join(have, key, "left")
            .withColumn("found", F.coalesce(F.col("found"), F.lit(False))))


def missing_tickers(requested: DataFrame, found: DataFrame, key: str = "ticker") -> DataFrame:
    return requested.select(key).distinct().join(found.select(key), key, "left_anti")


SEQ_SPAN = 2 * 10**19   # wider than all bigints; micros (below 2.5e17) times it stays under 10^38


def trade_order_key(ts: Column, seq: Column) -> Column:
    """(timestamp, sequence) packed into one exact ``decimal(38,0)``:
    micros * SEQ_SPAN + seq orders exactly like the pair, for every bigint
    sequence.  A struct key would give ``min_by``/``max_by`` a non-fixed-width
    buffer and force a sort-based aggregate (sorting every trade before the
    map-side combine); the decimal keeps them in the hash aggregate."""
    dec = "decimal(38,0)"
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(18,0)")
    return (micros * F.lit(str(SEQ_SPAN)).cast("decimal(20,0)")).cast(dec) + seq.cast("decimal(19,0)").cast(dec)


def bars_from_trades(trades: DataFrame, ticker: Column, ts: Column, price: Column,
                     qty: Column | None, seq: Column, keys: list[str] | None = None) -> DataFrame:
    """Aggregate trades into daily OHLCV bars (per extra ``keys`` too, e.g. a
    pull version).

    open/close are the prices of the first/last trade by (ts, seq); the
    aggregate is partial so hot tickers are combined before the shuffle."""
    extra = list(keys or [])
    order = trade_order_key(ts, seq)
    return (trades.select(*extra, ticker.alias("ticker"), F.to_date(ts).alias("date"),
                          price.alias("px"), order.alias("ord"),
                          (F.lit(1) if qty is None else qty).alias("q"))
            .groupBy(*extra, "ticker", "date")
            .agg(F.min_by("px", "ord").alias("open"), F.max("px").alias("high"),
                 F.min("px").alias("low"), F.max_by("px", "ord").alias("close"),
                 (F.count(F.lit(1)) if qty is None else F.sum("q")).cast("bigint").alias("volume")))


def prices_as_of(pulls: DataFrame, as_of, version_col: str = "as_of",
                 keys: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """State of dated price pulls as of a moment: per (ticker, date) the bar
    from the latest pull taken at or before ``as_of``.

    The version predicate is a plain filter, so a table partitioned by the
    pull column is pruned at the scan; the pick is a partial ``max_by``
    aggregate (versions of a hot ticker are reduced before the shuffle)."""
    payload = [c for c in pulls.columns if c not in keys and c != version_col]
    best = (pulls.filter(F.col(version_col) <= F.lit(as_of))
            .groupBy(*keys)
            .agg(F.max_by(F.struct(F.col(version_col), *[F.col(c) for c in payload]),
                          F.col(version_col)).alias("_r")))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [version_col] + payload])
