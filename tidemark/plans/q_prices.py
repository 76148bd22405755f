"""Price-bar queries (lineitem → long bars, events → short bars)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import prices as PR
from tidemark.plans import inputs as I
from tidemark.plans import sqlparts as P
from tidemark.plans.registry import query, rounded
from tidemark.sources.sinks import refresh_prices

CLEAN_SQL = """clean AS (
  SELECT * FROM bars
  WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL
    AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low AND volume >= 0)"""

RET_SQL = """ret AS (
  SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS return_1d FROM clean)"""

VOL_SQL = """round(lead(return_1d) OVER (PARTITION BY ticker ORDER BY date), 6) AS return_1d_fwd,
       round(CASE WHEN count(return_1d) OVER w20 = 20 THEN stddev_samp(return_1d) OVER w20 * sqrt(252) END, 6)
         AS volatility_20d"""

W20 = "WINDOW w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


def _clean_returns(bars):
    return PR.with_returns(PR.clean_prices(PR.normalise_columns(bars)))


@query("prices_clean", f"""WITH {P.BARS_LONG}, {CLEAN_SQL}, {RET_SQL}
SELECT ticker, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low,
       round(close, 6) AS close, volume, round(return_1d, 6) AS return_1d, {VOL_SQL}
FROM ret {W20}""")
def prices_clean(spark, d):
    return rounded(_clean_returns(I.bars_long(spark, d)))


@query("prices_short", f"""WITH {P.BARS_SHORT}, {CLEAN_SQL}, {RET_SQL}
SELECT ticker, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low,
       round(close, 6) AS close, volume, round(return_1d, 6) AS return_1d, {VOL_SQL}
FROM ret {W20}""")
def prices_short(spark, d):
    return rounded(_clean_returns(I.bars_short(spark, d)))


def _ret_cols():
    out = []
    for p in (1, 5, 20):
        out.append(f"round(close / lag(close, {p}) OVER w - 1, 6) AS return_{p}d")
    return ",\n       ".join(out)


@query("prices_returns", f"""WITH {P.BARS_LONG}, {CLEAN_SQL},
r AS (SELECT ticker, date, close,
             close / lag(close, 1) OVER w - 1 AS return_1d,
             close / lag(close, 5) OVER w - 1 AS return_5d,
             close / lag(close, 20) OVER w - 1 AS return_20d
      FROM clean WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, date, round(close, 6) AS close,
       round(return_1d, 6) AS return_1d, round(lead(return_1d, 1) OVER w, 6) AS return_1d_fwd,
       round(return_5d, 6) AS return_5d, round(lead(return_5d, 5) OVER w, 6) AS return_5d_fwd,
       round(return_20d, 6) AS return_20d, round(lead(return_20d, 20) OVER w, 6) AS return_20d_fwd
FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def prices_returns(spark, d):
    bars = PR.clean_prices(I.bars_long(spark, d)).select("ticker", "date", "close")
    return rounded(PR.calculate_returns(bars, "close", [1, 5, 20]))


def _sma_sql(n):
    return (f"CASE WHEN count(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING "
            f"AND CURRENT ROW) = {n} THEN avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN "
            f"{n - 1} PRECEDING AND CURRENT ROW) END")


_IND = f"""WITH {P.BARS_LONG}, {CLEAN_SQL},
g AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY ticker ORDER BY date), 0.0) AS delta FROM clean),
a AS (
  SELECT ticker, date, close, CAST(volume AS DOUBLE) AS vol,
         {_sma_sql(5)} AS sma_5, {_sma_sql(10)} AS sma_10, {_sma_sql(20)} AS sma_20, {_sma_sql(50)} AS sma_50,
         CASE WHEN count(close) OVER w20 = 20 THEN stddev_samp(close) OVER w20 END AS bb_std,
         CASE WHEN count(delta) OVER w14 = 14 THEN avg(CASE WHEN delta > 0 THEN delta ELSE 0.0 END) OVER w14 END AS gain,
         CASE WHEN count(delta) OVER w14 = 14 THEN avg(CASE WHEN delta < 0 THEN -delta ELSE 0.0 END) OVER w14 END AS loss,
         CASE WHEN count(volume) OVER w20 = 20 THEN avg(CAST(volume AS DOUBLE)) OVER w20 END AS volume_sma_20
  FROM g
  WINDOW w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
         w14 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT ticker, date, round(close, 6) AS close,
       round(sma_5, 6) AS sma_5, round(close / sma_5 - 1, 6) AS close_vs_sma_5,
       round(sma_10, 6) AS sma_10, round(close / sma_10 - 1, 6) AS close_vs_sma_10,
       round(sma_20, 6) AS sma_20, round(close / sma_20 - 1, 6) AS close_vs_sma_20,
       round(sma_50, 6) AS sma_50, round(close / sma_50 - 1, 6) AS close_vs_sma_50,
       round(sma_20, 6) AS bb_middle, round(sma_20 + bb_std * 2, 6) AS bb_upper,
       round(sma_20 - bb_std * 2, 6) AS bb_lower,
       round(CASE WHEN (sma_20 + bb_std * 2) - (sma_20 - bb_std * 2) = 0 THEN NULL
                  ELSE (close - (sma_20 - bb_std * 2)) / ((sma_20 + bb_std * 2) - (sma_20 - bb_std * 2)) END, 6)
         AS bb_position,
       round(CASE WHEN loss = 0 AND gain > 0 THEN 100.0 WHEN loss = 0 THEN NULL
                  ELSE 100.0 - 100.0 / (1.0 + gain / loss) END, 6) AS rsi,
       round(volume_sma_20, 6) AS volume_sma_20,
       round(CASE WHEN volume_sma_20 = 0 THEN NULL ELSE vol / volume_sma_20 END, 6) AS volume_ratio
FROM a"""


@query("prices_indicators", _IND)
def prices_indicators(spark, d):
    bars = PR.clean_prices(I.bars_long(spark, d)).select("ticker", "date", "close", "volume")
    return rounded(PR.technical_indicators(bars).drop("volume"))


@query("prices_latest", f"""WITH {P.BARS_LONG}, {CLEAN_SQL}, {RET_SQL},
v AS (SELECT *, CASE WHEN count(return_1d) OVER w20 = 20 THEN stddev_samp(return_1d) OVER w20 * sqrt(252) END
             AS volatility_20d,
             row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn,
             count(*) OVER (PARTITION BY ticker) AS rows, min(date) OVER (PARTITION BY ticker) AS first_date,
             max(date) OVER (PARTITION BY ticker) AS last_date
      FROM ret {W20})
SELECT ticker, rows, first_date, last_date, round(close, 6) AS latest_close,
       round(return_1d, 6) AS latest_return_1d, round(volatility_20d, 6) AS latest_volatility_20d
FROM v WHERE rn = 1""")
def prices_latest(spark, d):
    return rounded(PR.latest_per_ticker(_clean_returns(I.bars_long(spark, d))))


REFRESH_FROM = "2024-01-26"


@query("prices_refresh", f"""WITH {P.BARS_SHORT}, {CLEAN_SQL},
upd AS (SELECT ticker, date, close * 1.01 AS close FROM clean WHERE date >= DATE '{REFRESH_FROM}'),
merged AS (SELECT c.ticker, c.date, coalesce(u.close, c.close) AS close FROM clean c
           LEFT JOIN upd u ON c.ticker = u.ticker AND c.date = u.date),
ret AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS return_1d FROM merged)
SELECT ticker, date, round(close, 6) AS close, round(return_1d, 6) AS return_1d, {VOL_SQL}
FROM ret {W20}""")
def prices_refresh(spark, d):
    """Re-pulled last days replace stored bars (latest write wins); returns and
    volatility are derived from the merged history, not from the slice."""
    clean = PR.clean_prices(I.bars_short(spark, d)).select("ticker", "date", "close")
    fresh = clean.filter(F.col("date") >= F.lit(REFRESH_FROM).cast("date")).withColumn("close", F.col("close") * 1.01)
    return rounded(refresh_prices(clean, fresh, PR.with_returns))


@query("prices_requested_vs_found", f"""WITH {P.BARS_LONG},
req AS (SELECT DISTINCT 'SRC' || CAST(s_suppkey - 1 AS VARCHAR) AS ticker FROM supplier),
fnd AS (SELECT DISTINCT ticker FROM bars)
SELECT r.ticker, f.ticker IS NOT NULL AS found FROM req r LEFT JOIN fnd f USING (ticker)""")
def prices_requested_vs_found(spark, d):
    sup = I.table(spark, d, "supplier").select(
        F.concat(F.lit("SRC"), (F.col("s_suppkey") - 1).cast("string")).alias("ticker"))
    return PR.requested_vs_found(sup, I.bars_long(spark, d))


PULL_DAYS_BACK = 5
PULL_HOUR = 12
AS_OF = "2024-01-20 12:00:00"


def price_pulls(spark, d):
    """Dated copies of price pulls derived from events: every day A at noon a
    pull re-fetches the bars of the last 5 days [A-4, A] as known at that
    moment (day A's bar is partial).  Each event lands in at most 5 pulls, so
    the table grows linearly with the events."""
    ev = I.table(spark, d, "events")
    k = F.explode(F.sequence(F.lit(0), F.lit(PULL_DAYS_BACK - 1)))
    ev = ev.select("*", k.alias("_k"))
    ev = ev.withColumn("as_of", F.date_add(F.to_date("ts"), F.col("_k")).cast("timestamp")
                       + F.make_dt_interval(hours=F.lit(PULL_HOUR)))
    ev = ev.filter(F.col("ts") <= F.col("as_of"))
    return PR.bars_from_trades(ev, ticker=F.concat(F.lit("U"), F.col("user_id").cast("string")),
                               ts=F.col("ts"), price=F.col("value"), qty=None, seq=F.col("event_id"),
                               keys=["as_of"])


@query("prices_as_of", f"""WITH ev AS (
  SELECT e.*, CAST(CAST(ts AS DATE) + CAST(r.k AS INTEGER) AS TIMESTAMP) + INTERVAL {PULL_HOUR} HOUR AS as_of
  FROM events e, range(0, {PULL_DAYS_BACK}) r(k)),
pulls AS (
  SELECT as_of, 'U' || CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date,
         arg_min(value, {{'t': ts, 's': event_id}}) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, {{'t': ts, 's': event_id}}) AS close, CAST(count(*) AS BIGINT) AS volume
  FROM ev WHERE ts <= as_of GROUP BY 1, 2, 3),
pick AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY as_of DESC) AS rn
         FROM pulls WHERE as_of <= TIMESTAMP '{AS_OF}')
SELECT ticker, date, as_of, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low,
       round(close, 6) AS close, volume
FROM pick WHERE rn = 1""")
def prices_as_of(spark, d):
    """Bars as they were known at noon on 2024-01-20: per (ticker, date) the
    latest pull at or before that moment."""
    st = PR.prices_as_of(price_pulls(spark, d), datetime.fromisoformat(AS_OF))
    return rounded(st.select("ticker", "date", "as_of", "open", "high", "low", "close", "volume"))
