"""Flagship feature panel and its building blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.fixed import DEFAULT_LEXICON
from tidemark.operators import features as FE
from tidemark.operators import prices as PR
from tidemark.plans import inputs as I
from tidemark.plans import sqlparts as P
from tidemark.plans.q_aspects import DIM, SCORES, _vectors
from tidemark.plans.q_novelty import novelty_sql
from tidemark.plans.q_prices import CLEAN_SQL
from tidemark.plans.registry import query, rounded

ASPECTS = list(DEFAULT_LEXICON)

BAR_FACTORS_SQL = f"""{P.BARS_LONG}, {CLEAN_SQL},
b1 AS (SELECT ticker, date, close, CAST(volume AS DOUBLE) AS vol,
              close / lag(close) OVER w - 1 AS return_1d, close / lag(close, 20) OVER w - 1 AS return_20d,
              CASE WHEN count(volume) OVER w20 = 20 THEN avg(CAST(volume AS DOUBLE)) OVER w20 END AS vsma
       FROM clean
       WINDOW w AS (PARTITION BY ticker ORDER BY date),
              w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
fac0 AS (SELECT ticker, date, return_1d,
                lag(return_20d) OVER w AS momentum_20d,
                lag(CASE WHEN vsma = 0 THEN NULL ELSE vol / vsma END) OVER w AS volume_ratio
         FROM b1 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
mkt AS (SELECT date, avg(return_1d) AS market_return, count(return_1d) AS n_firms FROM fac0 GROUP BY date),
fac AS (SELECT fac0.*, mkt.market_return FROM fac0 LEFT JOIN mkt USING (date))"""

_ASPECT_COLS = ",\n       ".join(
    f"round(coalesce(max(CASE WHEN a.aspect = {P.q(x)} THEN a.s END), 0.0), 6) AS {x}_sentiment,\n       "
    f"round(coalesce(max(CASE WHEN a.aspect = {P.q(x)} THEN a.s END), 0.0) * n.novelty_score, 6) AS {x}_shock"
    for x in ASPECTS)

PANEL_SQL = f"""{SCORES},
ps AS (SELECT doc_id, paragraph_id, ticker, date, {P.sentiment_exprs('paragraph')['compound']} AS compound FROM paras),
day AS (SELECT ticker, date, avg(compound) AS sentiment_score FROM ps GROUP BY ticker, date),
asent AS (SELECT sc.ticker, sc.date, sc.aspect, avg(ps.compound) AS s
          FROM sc JOIN ps USING (doc_id, paragraph_id) WHERE sc.score_both IS NOT NULL
          GROUP BY sc.ticker, sc.date, sc.aspect),
fd AS (SELECT ticker, date, i AS dim, avg(CAST(len(list_filter(b, lambda x: x = i)) AS DOUBLE)) AS v
       FROM (SELECT *, {P.buckets('paragraph')} AS b FROM paras), range({DIM}) t(i)
       GROUP BY ticker, date, i),
days AS (SELECT DISTINCT ticker, date FROM day),
{novelty_sql('fd', 'days')},
{BAR_FACTORS_SQL},
nextday AS (SELECT k.ticker, k.date, min(c.date) AS trade_date FROM days k
         LEFT JOIN clean c ON c.ticker = k.ticker AND c.date > k.date GROUP BY k.ticker, k.date),
wide AS (SELECT d.ticker, d.date, d.sentiment_score, n.novelty_score,
       {_ASPECT_COLS}
       FROM day d JOIN nov n USING (ticker, date) LEFT JOIN asent a ON a.ticker = d.ticker AND a.date = d.date
       GROUP BY d.ticker, d.date, d.sentiment_score, n.novelty_score)"""


@query("feature_panel", f"""{PANEL_SQL}
SELECT w.ticker, w.date, x.trade_date, round(w.sentiment_score, 6) AS sentiment_score,
       round(w.novelty_score, 6) AS novelty_score,
       {", ".join(f"w.{a}_sentiment, w.{a}_shock" for a in ASPECTS)},
       round(f.return_1d, 6) AS forward_return, round(f.momentum_20d, 6) AS momentum_20d,
       round(f.volume_ratio, 6) AS volume_ratio, round(f.market_return, 6) AS market_return
FROM wide w JOIN nextday x USING (ticker, date)
LEFT JOIN fac f ON f.ticker = w.ticker AND f.date = x.trade_date""")
def feature_panel(spark, d):
    """Flagship: filings → paragraphs → sentiment, aspects, novelty → shocks →
    next-trading-day alignment with forward return and factors."""
    panel = FE.feature_panel(I.filings(spark, d), I.bars_long(spark, d), _vectors(spark), DEFAULT_LEXICON, DIM)
    return rounded(panel)


@query("trade_date_asof", f"""WITH {P.FILINGS}, {P.BARS_LONG}, {CLEAN_SQL}
SELECT f.doc_id, f.ticker, f.date, (SELECT min(c.date) FROM clean c WHERE c.ticker = f.ticker AND c.date > f.date)
       AS trade_date
FROM filings f""")
def trade_date_asof(spark, d):
    """Every filing mapped to the first trading day strictly after it."""
    f = I.filings(spark, d).select("doc_id", "ticker", "date")
    return FE.align_next_trade_day(f, PR.clean_prices(I.bars_long(spark, d)))


@query("equal_weighted_index", f"""WITH {BAR_FACTORS_SQL}
SELECT date, round(market_return, 6) AS market_return, n_firms FROM mkt""")
def equal_weighted_index(spark, d):
    b = PR.calculate_returns(PR.clean_prices(I.bars_long(spark, d)), "close", [1])
    return rounded(FE.equal_weighted_index(b))
