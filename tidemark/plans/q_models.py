"""Statistics, regression and evaluation queries on lineitem bar features and
on the flagship panel."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.operators import prices as PR
from tidemark.plans import inputs as I
from tidemark.plans import sqlparts as P
from tidemark.functions.fixed import DEFAULT_LEXICON
from tidemark.operators import features as FE
from tidemark.plans.q_aspects import _vectors
from tidemark.plans.q_features import PANEL_SQL
from tidemark.plans.q_prices import CLEAN_SQL
from tidemark.plans.registry import query, rounded

FEATS = ["return_1d", "return_5d", "return_20d", "volatility_20d", "volume_ratio"]
TARGET = "return_1d_fwd"
SEED = 42


def bar_features(spark, d):
    b = PR.clean_prices(I.bars_long(spark, d))
    b = PR.calculate_returns(b, "close", [1, 5, 20])
    b = PR.technical_indicators(b)
    b = b.withColumn("volatility_20d", PR.rolling(F.stddev_samp, F.col("return_1d"), 20) * math.sqrt(252))
    return b.select("ticker", "date", *FEATS, TARGET)


BF_SQL = f"""WITH {P.BARS_LONG}, {CLEAN_SQL},
bf0 AS (SELECT ticker, date, close / lag(close, 1) OVER w - 1 AS return_1d,
               close / lag(close, 5) OVER w - 1 AS return_5d, close / lag(close, 20) OVER w - 1 AS return_20d,
               CAST(volume AS DOUBLE) AS vol,
               CASE WHEN count(volume) OVER w20 = 20 THEN avg(CAST(volume AS DOUBLE)) OVER w20 END AS vsma
        FROM clean WINDOW w AS (PARTITION BY ticker ORDER BY date),
                          w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
bf AS (SELECT ticker, date, return_1d, return_5d, return_20d,
              CASE WHEN count(return_1d) OVER w20 = 20 THEN stddev_samp(return_1d) OVER w20 * sqrt(252) END
                AS volatility_20d,
              CASE WHEN vsma = 0 THEN NULL ELSE vol / vsma END AS volume_ratio,
              lead(return_1d) OVER w AS return_1d_fwd
       FROM bf0 WINDOW w AS (PARTITION BY ticker ORDER BY date),
                       w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
hs AS (SELECT *, ((('0x' || substr(md5(ticker || '|' || CAST(date AS VARCHAR) || '|{SEED}'), 1, 8))::BIGINT % 1000)
                  / 1000.0) AS u FROM bf),
train AS (SELECT * FROM hs WHERE u >= 0.3), test AS (SELECT * FROM hs WHERE u < 0.3),
fit AS (SELECT regr_intercept(return_1d_fwd, return_20d) AS a, regr_slope(return_1d_fwd, return_20d) AS b,
               regr_r2(return_1d_fwd, return_20d) AS r2
        FROM train WHERE return_1d_fwd IS NOT NULL AND return_20d IS NOT NULL)"""


def _describe_sql():
    parts = [f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
       round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
       round(max({c}), 6) AS max FROM bf""" for c in FEATS]
    return BF_SQL + "\n" + "\nUNION ALL\n".join(parts)


@query("feature_describe", _describe_sql())
def feature_describe(spark, d):
    return rounded(M.describe_features(bar_features(spark, d), FEATS))


MIN_ABS = 0.01


@query("feature_correlations", BF_SQL + "\nSELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(corr({c}, {TARGET}), 6) AS corr FROM bf" for c in FEATS)
    + f") WHERE abs(corr) >= {MIN_ABS}")
def feature_correlations(spark, d):
    return rounded(M.correlations(bar_features(spark, d), TARGET, FEATS, MIN_ABS))


def _fit(spark, d):
    train, test = M.hash_split(bar_features(spark, d), ["ticker", "date"], 0.3, SEED)
    return M.fit_ols(train, ["return_20d"], TARGET), train, test


@query("ols_fit", f"""{BF_SQL}
SELECT 'intercept' AS term, round(a, 6) AS coefficient FROM fit
UNION ALL SELECT 'return_20d', round(b, 6) FROM fit""")
def ols_fit(spark, d):
    model, _, _ = _fit(spark, d)
    return rounded(M.coefficient_frame(spark, model))


@query("ols_metrics", f"""{BF_SQL},
p AS (SELECT t.return_1d_fwd AS y, fit.a + fit.b * t.return_20d AS p FROM test t, fit
      WHERE t.return_1d_fwd IS NOT NULL AND t.return_20d IS NOT NULL)
SELECT count(*) AS n, round(avg((y - p) * (y - p)), 6) AS mse, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
       round(avg(abs(y - p)), 6) AS mae,
       round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2
FROM p""")
def ols_metrics(spark, d):
    model, _, test = _fit(spark, d)
    return rounded(M.evaluate(test, TARGET, model.predict()))


@query("ols_sample_errors", f"""{BF_SQL}
SELECT ticker, date, round(return_1d_fwd, 6) AS actual, round(fit.a + fit.b * return_20d, 6) AS predicted,
       round(return_1d_fwd - (fit.a + fit.b * return_20d), 6) AS error
FROM test, fit ORDER BY u, ticker, date LIMIT 5""")
def ols_sample_errors(spark, d):
    model, _, test = _fit(spark, d)
    return rounded(M.sample_errors(test, ["ticker", "date"], TARGET, model.predict(), 5, SEED))


@query("forecast_metrics", f"""{BF_SQL},
p AS (SELECT t.return_1d_fwd AS a, fit.a + fit.b * t.return_20d AS p FROM test t, fit
      WHERE t.return_1d_fwd IS NOT NULL AND t.return_20d IS NOT NULL)
SELECT count(*) AS n, round(avg(abs(a - p)), 6) AS mae, round(avg((a - p) * (a - p)), 6) AS mse,
       round(avg(CASE WHEN sign(a) = sign(p) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
       round(avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_up
FROM p""")
def forecast_metrics(spark, d):
    model, _, test = _fit(spark, d)
    pred = test.withColumn("predicted", model.predict())
    return rounded(M.forecast_metrics(pred, TARGET, "predicted"))


@query("predict_panel", f"""{PANEL_SQL},
panel AS (SELECT w.ticker, w.date, w.sentiment_score, w.novelty_score, f.return_1d AS forward_return
          FROM wide w JOIN nextday x USING (ticker, date)
          LEFT JOIN fac f ON f.ticker = w.ticker AND f.date = x.trade_date),
m AS (SELECT regr_intercept(forward_return, sentiment_score) AS a, regr_slope(forward_return, sentiment_score) AS b,
             regr_r2(forward_return, sentiment_score) AS r2 FROM panel
      WHERE forward_return IS NOT NULL AND sentiment_score IS NOT NULL)
SELECT date, ticker, round(a + b * sentiment_score, 6) AS predicted_return, round(r2, 6) AS confidence,
       round(sentiment_score, 6) AS sentiment_score, round(novelty_score, 6) AS novelty_score
FROM panel, m""")
def predict_panel(spark, d):
    """Next-day return predicted from firm-day sentiment (model fitted on the
    panel), with the model's R² as confidence."""
    panel = FE.feature_panel(I.filings(spark, d), I.bars_long(spark, d), _vectors(spark), DEFAULT_LEXICON, 64)
    model = M.fit_ols(panel, ["sentiment_score"], "forward_return")
    return rounded(M.predict(panel, model, ["date", "ticker", "sentiment_score", "novelty_score"]))


PREDICT_DATE = "1996-01-04"
PREDICT_TICKERS = ["SRC0", "SRC1", "SRC10", "SRC11", "SRC12", "SRC13"]


@query("predict_date", f"""{PANEL_SQL},
panel AS (SELECT w.ticker, w.date, w.sentiment_score, w.novelty_score, f.return_1d AS forward_return
          FROM wide w JOIN nextday x USING (ticker, date)
          LEFT JOIN fac f ON f.ticker = w.ticker AND f.date = x.trade_date),
m AS (SELECT regr_intercept(forward_return, sentiment_score) AS a, regr_slope(forward_return, sentiment_score) AS b,
             regr_r2(forward_return, sentiment_score) AS r2 FROM panel
      WHERE forward_return IS NOT NULL AND sentiment_score IS NOT NULL)
SELECT date, ticker, round(a + b * sentiment_score, 6) AS predicted_return, round(r2, 6) AS confidence,
       round(sentiment_score, 6) AS sentiment_score, round(novelty_score, 6) AS novelty_score
FROM panel, m
WHERE date = DATE '{PREDICT_DATE}' AND ticker IN ({", ".join(f"'{t}'" for t in PREDICT_TICKERS)})""")
def predict_date(spark, d):
    """The prediction command: one date and a ticker list, model fitted on the
    whole panel."""
    panel = _panel(spark, d)
    model = M.fit_ols(panel, ["sentiment_score"], "forward_return")
    return rounded(M.predict(panel, model, ["date", "ticker", "sentiment_score", "novelty_score"],
                             date=PREDICT_DATE, tickers=PREDICT_TICKERS))


GRANGER_LAGS = 5
COLLINEAR = M.COLLINEAR


def _panel(spark, d):
    return FE.feature_panel(I.filings(spark, d), I.bars_long(spark, d), _vectors(spark), DEFAULT_LEXICON, 64)


def _granger_sql(source: str) -> str:
    """Moments of every lag's regression as lists of lists, eliminated column by column; the F test's
    tail by the series of the incomplete beta function.  ``source``: g (group), date, y, x."""
    lags = range(1, GRANGER_LAGS + 1)
    whole = lambda p: " AND ".join(f"y{i} IS NOT NULL AND x{i} IS NOT NULL" for i in range(1, p + 1))
    design = "CASE p " + " ".join(
        f"WHEN {p} THEN [1.0, {', '.join(f'y{i}' for i in range(1, p + 1))}, {', '.join(f'x{i}' for i in range(1, p + 1))}, y]"
        for p in lags) + " END"
    beta = lambda x, a, b: (  # noqa: E731 - I_x(a, b)
        f"exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / {a} * "
        f"list_sum(list_transform(range(3000), lambda n: exp(lgamma({a} + {b} + n) - lgamma({a} + {b}) - lgamma({a} + 1 + n) "
        f"+ lgamma({a} + 1) + n * ln({x}))))")
    return f"""{PANEL_SQL.replace("WITH ", "WITH RECURSIVE ", 1)},
panel AS (SELECT w.ticker, w.date, w.sentiment_score, f.return_1d AS forward_return
          FROM wide w JOIN nextday x USING (ticker, date)
          LEFT JOIN fac f ON f.ticker = w.ticker AND f.date = x.trade_date),
src AS ({source}),
centred AS (SELECT g, date, y - avg(y) OVER (PARTITION BY g) AS y, x - avg(x) OVER (PARTITION BY g) AS x FROM src),
lagged AS (SELECT g, y, {", ".join(f"lag({c}, {i}) OVER w AS {c}{i}" for c in "yx" for i in lags)}
           FROM centred WINDOW w AS (PARTITION BY g ORDER BY date)),
deep AS (SELECT *, CASE {" ".join(f"WHEN {whole(p)} THEN {p}" for p in reversed(lags))} ELSE 0 END AS depth
         FROM lagged WHERE y IS NOT NULL),
served AS (SELECT *, unnest(range(1, depth + 1)) AS p, false AS common FROM deep
           UNION ALL SELECT *, unnest(range(1, {GRANGER_LAGS + 1})) AS p, true AS common FROM deep WHERE depth = {GRANGER_LAGS}),
vec AS (SELECT g, p, common, {design} AS z FROM served),
pair AS (SELECT g, p, common, i, j, count(*) AS n, sum(z[i] * z[j]) AS v
         FROM (SELECT g, p, common, z, unnest(range(1, len(z) + 1)) AS i FROM vec), range(1, {2 * GRANGER_LAGS + 3}) t(j)
         WHERE j <= len(z) GROUP BY g, p, common, i, j),
line AS (SELECT g, p, common, i, any_value(n) AS n, list(v ORDER BY j) AS r FROM pair GROUP BY g, p, common, i),
step AS (SELECT g, p, common, any_value(n) AS n, 1 AS k, list(r ORDER BY i) AS m, list(r[i] ORDER BY i) AS size,
                0 AS rank, 0.0::DOUBLE AS ssr_r FROM line GROUP BY g, p, common
  UNION ALL
  SELECT g, p, common, n, k + 1, m, size, rank, CASE WHEN k = 1 + p THEN m[2 * p + 2][2 * p + 2] ELSE ssr_r END
  FROM (SELECT g, p, common, n, k, size, ssr_r, rank + (rank < n AND m[k][k] > {COLLINEAR} * size[k])::INT AS rank,
               CASE WHEN rank < n AND m[k][k] > {COLLINEAR} * size[k]
                    THEN list_transform(range(1, 2 * p + 3), lambda i: list_transform(range(1, 2 * p + 3),
                           lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k])) ELSE m END AS m
        FROM step WHERE k <= 2 * p + 1)),
done AS (SELECT g, p, common, n, rank, 2 * p + 1 AS k, n - (2 * p + 1) AS df,
                CASE WHEN ssr_r > {COLLINEAR} * size[2 * p + 2] THEN ssr_r ELSE 0.0 END AS ssr_r,
                CASE WHEN m[2 * p + 2][2 * p + 2] > {COLLINEAR} * size[2 * p + 2] THEN m[2 * p + 2][2 * p + 2] ELSE 0.0 END AS ssr_u
         FROM step WHERE k = 2 * p + 2),
own AS (SELECT *, CASE WHEN df > 0 AND ssr_u > 0 THEN (ssr_r - ssr_u) / p / (ssr_u / df) END AS f FROM done WHERE NOT common),
bics AS (SELECT g, p, n AS n_bic, CASE WHEN n > k AND ssr_u > 0 THEN n * ln(ssr_u / n) + k * ln(n) END AS bic FROM done WHERE common),
tail AS (SELECT o.*, b.bic, coalesce(b.n_bic, 0) AS n_bic, df / 2.0 AS a, o.p / 2.0 AS b, df / (df + o.p * f) AS q
         FROM own o LEFT JOIN bics b ON b.g = o.g AND b.p = o.p)
SELECT g, p::INT AS lag, n, round(ssr_r, 6) AS ssr_restricted, round(ssr_u, 6) AS ssr_unrestricted, round(f, 6) AS f_stat,
       p::INT AS df_num, df::INT AS df_den,
       round(CASE WHEN f IS NULL THEN NULL WHEN f <= 0 THEN 1.0
                  WHEN q <= (a + 1) / (a + b + 2) THEN {beta("q", "a", "b")}
                  ELSE 1 - ({beta("(1 - q)", "b", "a")}) END, 6) AS p_value,
       round(bic, 6) AS bic, n_bic, rank::INT AS rank,
       bic IS NOT NULL AND p = first_value(p) OVER (PARTITION BY g ORDER BY bic NULLS LAST, p) AS selected
FROM tail"""


def _missing_as_null(df):
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("granger_panel", f"""SELECT g AS ticker, * EXCLUDE (g) FROM (
{_granger_sql("SELECT ticker AS g, date, forward_return AS y, sentiment_score AS x FROM panel")})""")
def granger_panel(spark, d):
    """Per firm: does lagged firm-day sentiment help predict the next trading
    day's return (lags 1..5, F test, BIC-selected lag)?"""
    g = M.granger_causality(_panel(spark, d), "forward_return", "sentiment_score", ["ticker"], "date",
                            GRANGER_LAGS)
    return rounded(_missing_as_null(g))


@query("granger_index", f"""SELECT * EXCLUDE (g) FROM (
{_granger_sql("SELECT 1 AS g, date, avg(forward_return) AS y, avg(sentiment_score) AS x FROM panel GROUP BY date")})""")
def granger_index(spark, d):
    """The same test on the equal-weighted series: mean next-day return and
    mean sentiment over firms per date."""
    idx = (_panel(spark, d).groupBy("date")
           .agg(F.avg("forward_return").alias("forward_return"), F.avg("sentiment_score").alias("sentiment_score")))
    return rounded(_missing_as_null(M.granger_causality(idx, "forward_return", "sentiment_score", None, "date", GRANGER_LAGS)))


DECILE_SQL = f"""{BF_SQL},
dec AS (SELECT date, ticker, return_20d, return_1d_fwd,
               ntile(10) OVER (PARTITION BY date ORDER BY return_20d, ticker) AS decile
        FROM bf WHERE return_20d IS NOT NULL AND return_1d_fwd IS NOT NULL),
spread AS (SELECT date, avg(CASE WHEN decile = 10 THEN return_1d_fwd END) AS top,
                  avg(CASE WHEN decile = 1 THEN return_1d_fwd END) AS bottom, count(*) AS n_firms
           FROM dec GROUP BY date)"""


@query("decile_spread", f"""{DECILE_SQL}
SELECT date, round(top, 6) AS top, round(bottom, 6) AS bottom, n_firms, round(top - bottom, 6) AS spread
FROM spread""")
def decile_spread(spark, d):
    return rounded(M.long_short_deciles(bar_features(spark, d), "return_20d", TARGET))


@query("performance", f"""{DECILE_SQL},
mkt AS (SELECT date, avg(return_1d_fwd) AS bench FROM bf GROUP BY date),
s AS (SELECT s.date, s.top - s.bottom AS r, m.bench FROM spread s LEFT JOIN mkt m USING (date)
      WHERE s.top - s.bottom IS NOT NULL),
w AS (SELECT *, CASE WHEN max(CASE WHEN r <= -1 THEN 1 ELSE 0 END) OVER run = 1 THEN 0.0
                     ELSE exp(sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER run) END AS wealth
      FROM s WINDOW run AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dd AS (SELECT *, wealth / greatest(max(wealth) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) - 1
              AS drawdown FROM w)
SELECT count(*) AS n_days, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe,
       round(avg(r) * 252, 6) AS annual_return, round(min(drawdown), 6) AS max_drawdown,
       round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
       round(avg(r - bench) / stddev_samp(r - bench) * sqrt(252), 6) AS information_ratio
FROM dd""")
def performance(spark, d):
    """Long-short decile spread series: Sharpe, annual return, max drawdown,
    hit rate, information ratio against the equal-weighted market."""
    ls = M.long_short_deciles(bar_features(spark, d), "return_20d", TARGET, market=True)
    series = ls.select("date", F.col("spread").alias("r"), F.col("market").alias("bench"))
    return rounded(M.performance_metrics(series.filter(F.col("r").isNotNull()), "r", "date", "bench"))


def _folds_sql(horizon: int) -> str:
    return f"""WITH {P.BARS_LONG}, {CLEAN_SQL},
dd AS (SELECT DISTINCT date FROM clean),
r AS (SELECT date, dense_rank() OVER (ORDER BY date) AS rk, (SELECT count(*) FROM dd) AS n FROM dd),
f AS (SELECT date, rk, n, fold, floor(n * 0.7) + fold * ceil((n - floor(n * 0.7)) / 5.0) AS st
      FROM r, range(5) t(fold))
SELECT CAST(fold AS INTEGER) AS fold, date,
       CASE WHEN rk > st AND rk <= st + ceil((n - floor(n * 0.7)) / 5.0) THEN 'test' ELSE 'train' END AS role
FROM f WHERE (rk > st AND rk <= st + ceil((n - floor(n * 0.7)) / 5.0)) OR rk <= st - {horizon}"""


@query("walk_forward", _folds_sql(0))
def walk_forward(spark, d):
    return M.walk_forward(PR.clean_prices(I.bars_long(spark, d)), "date", 0.7, 5, 0)


@query("purged_walk_forward", _folds_sql(5))
def purged_walk_forward(spark, d):
    """Folds with the 5 dates before each test block purged from training."""
    return M.walk_forward(PR.clean_prices(I.bars_long(spark, d)), "date", 0.7, 5, 5)


FM_SQL = f"""{BF_SQL},
per AS (SELECT date, CASE WHEN var_pop(return_20d) > 0 THEN regr_slope(return_1d_fwd, return_20d) END AS slope,
               CASE WHEN var_pop(return_20d) > 0 THEN regr_intercept(return_1d_fwd, return_20d) END AS intercept,
               count(*) AS n
        FROM bf WHERE return_1d_fwd IS NOT NULL AND return_20d IS NOT NULL GROUP BY date),
perk AS (SELECT * FROM per WHERE slope IS NOT NULL)"""


@query("fama_macbeth_daily", f"""{FM_SQL}
SELECT date, round(slope, 6) AS slope, round(intercept, 6) AS intercept, n FROM perk""")
def fama_macbeth_daily(spark, d):
    per, _ = M.fama_macbeth(bar_features(spark, d), TARGET, "return_20d")
    return rounded(per)


@query("fama_macbeth", f"""{FM_SQL}
SELECT round(avg(slope), 6) AS slope_mean, round(stddev_samp(slope) / sqrt(count(slope)), 6) AS slope_se,
       round(avg(slope) / (stddev_samp(slope) / sqrt(count(slope))), 6) AS slope_t,
       round(avg(intercept), 6) AS intercept_mean,
       round(stddev_samp(intercept) / sqrt(count(intercept)), 6) AS intercept_se,
       round(avg(intercept) / (stddev_samp(intercept) / sqrt(count(intercept))), 6) AS intercept_t,
       count(*) AS n_dates
FROM perk""")
def fama_macbeth(spark, d):
    _, summary = M.fama_macbeth(bar_features(spark, d), TARGET, "return_20d")
    return rounded(summary)


NW_LAGS = 5


@query("newey_west", f"""{FM_SQL},
c AS (SELECT date, slope, slope - (SELECT avg(slope) FROM perk) AS dv FROM perk),
l AS (SELECT *, {", ".join(f"dv * lag(dv, {k}) OVER (ORDER BY date) AS l{k}" for k in range(1, NW_LAGS + 1))} FROM c),
a AS (SELECT count(*) AS n, avg(slope) AS mean, sum(dv * dv) AS g0,
             {", ".join(f"sum(l{k}) AS g{k}" for k in range(1, NW_LAGS + 1))} FROM l),
v AS (SELECT n, mean, (g0 {" ".join(f"+ 2 * (1 - {k} / {NW_LAGS + 1}.0) * coalesce(g{k}, 0.0)" for k in range(1, NW_LAGS + 1))}) / n AS lrv FROM a)
SELECT n, round(mean, 6) AS mean, round(sqrt(lrv / n), 6) AS nw_se, round(mean / sqrt(lrv / n), 6) AS nw_t FROM v""")
def newey_west(spark, d):
    """HAC standard error of the mean Fama-MacBeth slope (Bartlett, 5 lags)."""
    per, _ = M.fama_macbeth(bar_features(spark, d), TARGET, "return_20d")
    return rounded(M.newey_west(per, "slope", "date", NW_LAGS))


B = 200
BOOT_SEED = 7


def _poisson_case(u: str) -> str:
    return " + ".join(f"CASE WHEN {u} >= {t!r} THEN 1 ELSE 0 END" for t in M.poisson_thresholds())


@query("cluster_bootstrap", f"""{BF_SQL},
per AS (SELECT ticker, sum(return_1d_fwd) AS s, count(*) AS n FROM bf WHERE return_1d_fwd IS NOT NULL GROUP BY ticker),
rep AS (SELECT ticker, s, n, r AS replicate,
               (('0x' || substr(md5(ticker || '|' || CAST(r AS VARCHAR) || '|{BOOT_SEED}'), 1, 13))::BIGINT)::DOUBLE
               / {float(2**52)!r} AS u
        FROM per, range(1, {B + 1}) t(r)),
w AS (SELECT replicate, ({_poisson_case('u')}) AS wt, s, n FROM rep),
st AS (SELECT replicate, CASE WHEN sum(wt * n) = 0 THEN NULL ELSE sum(wt * s) / sum(wt * n) END AS stat
       FROM w GROUP BY replicate)
SELECT round((SELECT sum(s) / sum(n) FROM per), 6) AS mean, round(stddev_samp(stat), 6) AS boot_std,
       round(quantile_cont(stat, 0.025), 6) AS ci_low, round(quantile_cont(stat, 0.975), 6) AS ci_high
FROM st""")
def cluster_bootstrap(spark, d):
    """Firm-clustered bootstrap (200 replicates) of the mean next-day return."""
    return rounded(M.cluster_bootstrap(bar_features(spark, d), "ticker", TARGET, B, BOOT_SEED))


def _sweep_sql(n: int) -> str:
    """``m`` after Gauss-Jordan elimination of column ``k`` of an n-row matrix (a list of lists)."""
    return (f"list_transform(range(1, {n + 1}), lambda i: CASE WHEN i = k "
            "THEN list_transform(m[k], lambda v: v / m[k][k]) "
            "ELSE list_transform(range(1, len(m[k]) + 1), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END)")


def _solved_sql(n: int, source: str) -> str:
    """CTEs that reduce the n-row matrix ``m`` of the one-row table ``source`` to [identity | solution]."""
    return f"""swept AS (SELECT 1 AS k, m FROM {source}
  UNION ALL SELECT k + 1, {_sweep_sql(n)} FROM swept WHERE k <= {n}),
solved AS (SELECT m FROM swept WHERE k = {n + 1})"""


PANEL_ROUNDS = 40


def _panel_fe_sql(xs: list[str]) -> str:
    """Within-firm and within-date means taken out in turn until nothing changes, then the slopes by
    elimination on their cross products and the firms' scores."""
    v = ["y", *[f"x{i}" for i in range(1, len(xs) + 1)]]
    minus = lambda by: ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {by}) AS {c}" for c in v)
    k = len(xs)
    matrix = "[" + ", ".join("[" + ", ".join([f"sum(x{i} * x{j})" for j in range(1, k + 1)] + [f"sum(x{i} * y)"]
                                             + [f"{float(i == j)}" for j in range(1, k + 1)]) + "]" for i in range(1, k + 1)) + "]"
    fit = " - ".join(["y"] + [f"m[{i}][{k + 1}] * x{i}" for i in range(1, k + 1)])
    bread = lambda i, j: f"m[{i}][{k + 1 + j}]"
    error = {i: " + ".join(f"{bread(i, a)} * {bread(i, b)} * sum(s{a} * s{b})" for a in range(1, k + 1) for b in range(1, k + 1))
             for i in range(1, k + 1)}
    return f"""{BF_SQL.replace("WITH ", "WITH RECURSIVE ", 1)},
start AS (SELECT ticker, date, {TARGET} AS y, {", ".join(f"{x} AS x{i}" for i, x in enumerate(xs, 1))} FROM bf
          WHERE {TARGET} IS NOT NULL AND {" AND ".join(f"{x} IS NOT NULL" for x in xs)}),
turn AS (SELECT 0 AS round, * FROM start
  UNION ALL SELECT round + 1, ticker, date, {minus("date")} FROM (SELECT round, ticker, date, {minus("ticker")} FROM turn)
  WHERE round < {PANEL_ROUNDS}),
within_ AS (SELECT * FROM turn WHERE round = {PANEL_ROUNDS}),
moment AS (SELECT {matrix} AS m FROM within_),
{_solved_sql(k, "moment")},
score AS (SELECT m, ticker, count(*) AS n, {", ".join(f"sum(x{i} * ({fit})) AS s{i}" for i in range(1, k + 1))}
          FROM within_, solved GROUP BY m, ticker),
coefficient AS (SELECT unnest([{", ".join(f"'{x}'" for x in xs)}]) AS term,
       unnest([{", ".join(f"m[{i}][{k + 1}]" for i in range(1, k + 1))}]) AS slope,
       unnest([{", ".join(f"sqrt({error[i]})" for i in range(1, k + 1))}]) AS cluster_se,
       sum(n)::BIGINT AS n_obs, count(*) AS n_entities FROM score GROUP BY m)"""


@query("panel_fixed_effects", f"""{_panel_fe_sql(["return_20d"])}
SELECT round(slope, 6) AS slope, round(cluster_se, 6) AS cluster_se, n_obs, n_entities FROM coefficient""")
def panel_fixed_effects(spark, d):
    """Two-way (firm, date) fixed-effects slope of next-day return on 20-day
    momentum with firm-clustered error."""
    return rounded(M.panel_ols_fe(bar_features(spark, d), TARGET, "return_20d"))


def _ols_multi_sql() -> str:
    """Normal equations of the centred regressors, then their elimination."""
    k = len(FEATS)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*FEATS, TARGET])
    cov = lambda a, b: f"covar_pop({a}, {b})"
    matrix = "[" + ", ".join("[" + ", ".join([cov(a, b) for b in FEATS] + [cov(a, TARGET)]) + "]" for a in FEATS) + "]"
    return f"""{BF_SQL.replace("WITH ", "WITH RECURSIVE ", 1)},
whole AS (SELECT * FROM bf WHERE {complete}),
moment AS (SELECT {matrix} AS m FROM whole),
{_solved_sql(k, "moment")},
means AS (SELECT avg({TARGET}) AS y, [{", ".join(f"avg({c})" for c in FEATS)}] AS x FROM whole)"""


@query("ols_multi", f"""{_ols_multi_sql()}
SELECT 'intercept' AS term, round(y - list_sum(list_transform(range(1, {len(FEATS) + 1}), lambda i: x[i] * m[i][{len(FEATS) + 1}])), 6) AS coefficient
FROM means, solved
UNION ALL SELECT unnest([{", ".join(f"'{c}'" for c in FEATS)}]), round(unnest(list_transform(m, lambda r: r[{len(FEATS) + 1}])), 6) FROM solved""")
def ols_multi(spark, d):
    """Multi-factor OLS of next-day return (coefficients from one aggregate of
    cross-products; unit-tested against numpy)."""
    model = M.fit_ols(bar_features(spark, d), FEATS, TARGET)
    return rounded(M.coefficient_frame(spark, model))


@query("panel_multi_factor", f"""{_panel_fe_sql(["return_1d", "return_20d", "volume_ratio"])}
SELECT term, round(slope, 9) AS slope, round(cluster_se, 9) AS cluster_se, round(slope / cluster_se, 9) AS t, n_obs, n_entities
FROM coefficient""")
def panel_multi_factor(spark, d):
    """Two-way fixed effects of the next-day return on three regressors with
    firm-clustered errors."""
    return rounded(M.panel_coefficients(bar_features(spark, d), TARGET, ["return_1d", "return_20d", "volume_ratio"]), 9)


@query("fama_macbeth_multi", f"""{BF_SQL},
k AS (SELECT date, return_1d_fwd AS y, return_20d AS a, volume_ratio AS b FROM bf
      WHERE return_1d_fwd IS NOT NULL AND return_20d IS NOT NULL AND volume_ratio IS NOT NULL),
m AS (SELECT date, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb,
             covar_pop(a, b) AS ab, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb FROM k GROUP BY date),
s AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS s1, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS s2
      FROM m WHERE n > 2 AND aa > 0 AND bb > 0 AND 1 - ab * ab / (aa * bb) > 1e-9),
long AS (SELECT 'intercept' AS term, my - s1 * ma - s2 * mb AS b FROM s
         UNION ALL SELECT 'return_20d', s1 FROM s UNION ALL SELECT 'volume_ratio', s2 FROM s)
SELECT term, round(avg(b), 8) AS mean, round(stddev_samp(b) / sqrt(count(b)), 8) AS se,
       round(avg(b) / (stddev_samp(b) / sqrt(count(b))), 8) AS t, count(b) AS n_dates FROM long GROUP BY term""")
def fama_macbeth_multi(spark, d):
    """Fama-MacBeth of the next-day return on momentum and volume ratio."""
    return rounded(M.fama_macbeth_multi(bar_features(spark, d), TARGET, ["return_20d", "volume_ratio"]), 8)


@query("out_of_sample", f"""{BF_SQL},
dd AS (SELECT DISTINCT date FROM clean),
rk AS (SELECT date, dense_rank() OVER (ORDER BY date) AS r, (SELECT count(*) FROM dd) AS n FROM dd),
fo AS (SELECT fold, date, CASE WHEN r > st AND r <= st + w THEN 'test' WHEN r <= st THEN 'train' END AS role
       FROM (SELECT fold, date, r, floor(n * 0.7) + fold * ceil((n - floor(n * 0.7)) / 5.0) AS st,
                    ceil((n - floor(n * 0.7)) / 5.0) AS w FROM rk, range(5) t(fold))),
p AS (SELECT fo.fold, fo.role, bf.return_20d AS x, bf.return_1d_fwd AS y FROM bf JOIN fo USING (date)
      WHERE role IS NOT NULL AND return_20d IS NOT NULL AND return_1d_fwd IS NOT NULL),
f AS (SELECT fold, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, count(*) AS n FROM p WHERE role = 'train' GROUP BY fold),
e AS (SELECT p.fold, f.n, p.y, f.a + f.b * p.x AS h FROM p JOIN f USING (fold) WHERE p.role = 'test')
SELECT CAST(fold AS INTEGER) AS fold, max(n) AS n_train, count(*) AS n_test, round(avg((y - h) * (y - h)), 10) AS mse,
       round(avg(abs(y - h)), 10) AS mae, round(avg(CASE WHEN sign(y) = sign(h) THEN 1.0 ELSE 0.0 END), 10) AS hit_rate
FROM e GROUP BY fold""")
def out_of_sample(spark, d):
    """Each walk-forward fold: fit on its train dates, score its test dates."""
    folds = M.walk_forward(PR.clean_prices(I.bars_long(spark, d)), "date", 0.7, 5, 0)
    return rounded(M.out_of_sample(bar_features(spark, d), ["return_20d"], TARGET, folds), 10)


@query("factor_merge", f"""{BF_SQL},
size AS (SELECT ticker, date, ln(close * volume) AS size FROM clean WHERE close * volume > 0),
mk AS (SELECT date, avg(return_1d) AS mkt FROM bf GROUP BY date)
SELECT bf.ticker, bf.date, round(bf.return_20d, 6) AS return_20d, round(s.size, 6) AS size, round(mk.mkt, 6) AS mkt
FROM bf LEFT JOIN size s ON s.ticker = bf.ticker AND s.date = bf.date LEFT JOIN mk ON mk.date = bf.date""")
def factor_merge(spark, d):
    """Supplied factor tables on the firm-day panel: size by firm and date, the market by date."""
    bars = PR.clean_prices(I.bars_long(spark, d))
    bf = bar_features(spark, d).select("ticker", "date", "return_1d", "return_20d")
    worth = F.col("close") * F.col("volume")
    size = bars.filter(worth > 0).select("ticker", "date", F.log(worth).alias("size"))
    market = bf.groupBy("date").agg(F.avg("return_1d").alias("mkt"))
    return rounded(FE.attach_factors(bf.select("ticker", "date", "return_20d"), size, market))
