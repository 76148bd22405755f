"""Statistics, regression and evaluation on feature panels.

Everything that scans rows is a Spark aggregate; only k×k moment matrices (k =
number of regressors) reach the driver, where a small linear solve runs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fixed import TRADING_DAYS_PER_YEAR
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.ranks import ntile, ranked
from tidemark.session import cut_lineage

# ------------------------------------------------------------ describe / corr


def describe_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles (exact, linear interpolation), max per
    column.  Moments come from one aggregate pass; the quartiles from
    ``exact_quantiles`` over the stacked (feature, value) rows, so a column is
    never gathered into one task (Spark's exact ``percentile`` would merge every
    distinct value of the whole table into one buffer)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__count").alias("count"),
                              F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                              F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max")) for c in cols])
    stats = one.select(F.inline(rows))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                                        for c in cols])))
    q = exact_quantiles(long, "v", [0.25, 0.5, 0.75], ["feature"])
    wide = q.groupBy("feature").agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
                                      for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return (stats.join(wide, "feature", "left")
            .select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max"))


def correlations(df: DataFrame, target: str, cols: list[str], min_abs: float = 0.05) -> DataFrame:
    """Pearson correlation of each numeric feature with ``target`` (one pass),
    keeping |corr| >= min_abs, strongest first."""
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in cols])
    long = one.select(F.inline(rows))
    return long.filter(F.abs("corr") >= min_abs).orderBy(F.abs("corr").desc(), "feature")


# ------------------------------------------------------------ splits


def hash_fraction(cols: list[str], seed: int) -> Column:
    """Deterministic uniform-ish number in [0, 1) from md5 of the key columns
    and a seed — independent of partitioning."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(1000)) / 1000.0


def hash_split(df: DataFrame, key_cols: list[str], test_frac: float = 0.3, seed: int = 42):
    u = hash_fraction(key_cols, seed)
    return df.filter(u >= test_frac), df.filter(u < test_frac)


# ------------------------------------------------------------ OLS


@dataclass
class LinearModel:
    features: list[str]
    coefficients: list[float]   # intercept first
    n: int
    r2: float

    def predict(self) -> Column:
        expr = F.lit(self.coefficients[0])
        for f, b in zip(self.features, self.coefficients[1:]):
            expr = expr + F.col(f).cast("double") * F.lit(b)
        return expr


def moments(df: DataFrame, features: list[str], target: str, weight: str | None = None) -> dict:
    """One aggregate: n, X'X, X'y, y'y, sum y (intercept included)."""
    xs = [F.lit(1.0)] + [F.col(f).cast("double") for f in features]
    y = F.col(target).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    k = len(xs)
    complete = y.isNotNull()
    for f in features:
        complete = complete & F.col(f).isNotNull()
    d = df.filter(complete)
    aggs = [F.sum(w).alias("n")]
    for i in range(k):
        for j in range(i, k):
            aggs.append(F.sum(w * xs[i] * xs[j]).alias(f"xx_{i}_{j}"))
        aggs.append(F.sum(w * xs[i] * y).alias(f"xy_{i}"))
    aggs += [F.sum(w * y * y).alias("yy"), F.sum(w * y).alias("sy")]
    r = d.agg(*aggs).collect()[0]
    xx = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = r[f"xx_{i}_{j}"] or 0.0
    xy = np.array([r[f"xy_{i}"] or 0.0 for i in range(k)])
    return {"n": r["n"] or 0.0, "xx": xx, "xy": xy, "yy": r["yy"] or 0.0, "sy": r["sy"] or 0.0}


def fit_ols(df: DataFrame, features: list[str], target: str) -> LinearModel:
    """Ordinary least squares with intercept over complete rows.

    One regressor: the covariance closed form (``regr_slope`` / ``regr_intercept``
    aggregates, numerically the steadiest).  Several: one aggregate of
    centred cross-products and a scaled k×k solve on the driver."""
    if not features:
        raise ValueError("no regressor")
    if len(features) == 1:
        x, y = features[0], target
        d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        r = d.agg(F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"),
                  F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n")).collect()[0]
        if r["b"] is None:     # no rows, or a regressor without variance
            raise ValueError(f"{x} does not vary over the {r['n']} complete rows")
        return LinearModel(features, [float(r["a"]), float(r["b"])], int(r["n"]),
                           float("nan") if r["r2"] is None else float(r["r2"]))
    m = centred_moments(df, features, target)
    if not m["n"]:
        raise ValueError("no complete rows to fit")
    scale = np.sqrt(np.maximum(np.diag(m["xx"]), 0.0))
    scale[scale == 0] = 1.0
    slopes = np.linalg.lstsq(m["xx"] / np.outer(scale, scale), m["xy"] / scale, rcond=None)[0] / scale
    sse = m["yy"] - 2 * slopes @ m["xy"] + slopes @ m["xx"] @ slopes
    r2 = 1 - sse / m["yy"] if m["yy"] else float("nan")
    return LinearModel(features, [float(m["my"] - slopes @ m["mx"]), *map(float, slopes)], int(m["n"]), float(r2))


def fit_ols_by(df: DataFrame, key: str, feature: str, target: str) -> dict:
    """``fit_ols`` on one regressor for every value of ``key`` in one pass; few values are expected."""
    d = df.filter(F.col(feature).isNotNull() & F.col(target).isNotNull())
    out = {}
    for r in d.groupBy(key).agg(F.regr_intercept(target, feature).alias("a"), F.regr_slope(target, feature).alias("b"),
                                F.regr_r2(target, feature).alias("r2"), F.count(F.lit(1)).alias("n")).collect():
        if r["b"] is None:
            raise ValueError(f"{feature} does not vary over the {r['n']} complete rows")
        out[r[key]] = LinearModel([feature], [float(r["a"]), float(r["b"])], int(r["n"]),
                                  float("nan") if r["r2"] is None else float(r["r2"]))
    return out


def centred_moments(df: DataFrame, features: list[str], target: str) -> dict:
    """n, means and centred cross products of complete rows: one aggregate for the
    means, one for the products about them (no digits are lost to large means).  The rows are
    checkpointed, so that what makes them runs once."""
    names = [target, *features]
    complete = F.lit(True)
    for c in names:
        complete = complete & F.col(c).isNotNull()
    d = cut_lineage(df.filter(complete).select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]))
    first = d.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(names))]).collect()[0]
    k = len(names)
    if not first["n"]:
        return {"n": 0}
    mean = [float(first[f"m{i}"]) for i in range(k)]
    r = d.agg(*[F.sum((F.col(f"v{i}") - mean[i]) * (F.col(f"v{j}") - mean[j])).alias(f"c{i}_{j}")
                for i in range(k) for j in range(i, k)]).collect()[0]
    c = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return {"n": first["n"], "mx": np.array(mean[1:]), "my": mean[0], "xx": c[1:, 1:], "xy": c[1:, 0], "yy": c[0, 0]}


def coefficient_frame(spark, model: LinearModel) -> DataFrame:
    rows = [("intercept", model.coefficients[0])] + list(zip(model.features, model.coefficients[1:]))
    return spark.createDataFrame(rows, "term string, coefficient double")


def evaluate(df: DataFrame, target: str, pred: Column) -> DataFrame:
    """n, MSE, RMSE, MAE, R² of predictions (one aggregate)."""
    d = df.select(F.col(target).cast("double").alias("y"), pred.alias("p")).filter(
        F.col("y").isNotNull() & F.col("p").isNotNull())
    e = F.col("y") - F.col("p")
    out = d.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                F.sum(e * e).alias("_sse"), F.var_pop("y").alias("_vy"))
    return out.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae",
                      (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_vy") * F.col("n"))).alias("r2"))


def sample_errors(df: DataFrame, key_cols: list[str], target: str, pred: Column, n: int = 5,
                  seed: int = 42) -> DataFrame:
    """``n`` pseudo-random rows (hash order) with actual, predicted and error;
    the limit is the feature here (a sample for display)."""
    d = df.select(*key_cols, F.col(target).alias("actual"), pred.alias("predicted"))
    d = d.withColumn("error", F.col("actual") - F.col("predicted"))
    return d.orderBy(hash_fraction(key_cols, seed), *key_cols).limit(n)


def predict(df: DataFrame, model: LinearModel, keep: list[str], date=None, tickers=None,
            date_col: str = "date", key: str = "ticker") -> DataFrame:
    """Predicted return per row, optionally only for one ``date`` and a list of
    ``tickers`` (plain predicates, pushed down); ``confidence`` is the model's
    in-sample R² (the original left it undefined)."""
    if date is not None:
        df = df.filter(F.col(date_col) == F.lit(date))
    if tickers:
        df = df.filter(F.col(key).isin(list(tickers)))
    return df.select(*keep, model.predict().alias("predicted_return"),
                     F.lit(model.r2).alias("confidence"))


# ------------------------------------------------------------ evaluation


def forecast_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    d = df.filter(a.isNotNull() & p.isNotNull())
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(a - p)).alias("mae"),
                 F.avg((a - p) * (a - p)).alias("mse"),
                 F.avg(F.when(F.signum(a) == F.signum(p), 1.0).otherwise(0.0)).alias("hit_rate"),
                 F.avg(F.when(a > 0, 1.0).otherwise(0.0)).alias("share_up"))


def performance_metrics(series: DataFrame, ret: str, date_col: str = "date",
                        bench: str | None = None) -> DataFrame:
    """Sharpe, annual return, max drawdown, hit rate, information ratio of a
    daily return series.  The drawdown needs one ordered pass over the series
    (one row per date, bounded by the calendar)."""
    r = F.col(ret)
    w = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, 0)
    # wealth = prod(1 + r); a return <= -1 ruins the series (wealth 0 from then on)
    growth = F.sum(F.when(r > -1, F.log(F.lit(1.0) + r))).over(w)
    ruined = F.max(F.when(r <= -1, 1).otherwise(0)).over(w)
    s = series.filter(r.isNotNull()).withColumn(
        "_wealth", F.when(ruined == 1, F.lit(0.0)).otherwise(F.exp(growth)))
    s = s.withColumn("_dd", F.col("_wealth") / F.greatest(F.max("_wealth").over(w), F.lit(1.0)) - 1)
    ann = math.sqrt(TRADING_DAYS_PER_YEAR)
    active = (r - F.col(bench)) if bench else r
    return s.agg(F.count(F.lit(1)).alias("n_days"),
                 (F.try_divide(F.avg(r), F.stddev_samp(r)) * ann).alias("sharpe"),
                 (F.avg(r) * TRADING_DAYS_PER_YEAR).alias("annual_return"),
                 F.min("_dd").alias("max_drawdown"),
                 F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
                 (F.try_divide(F.avg(active), F.stddev_samp(active)) * ann).alias("information_ratio"))


def long_short_deciles(df: DataFrame, score: str, ret: str, date_col: str = "date",
                       key: str = "ticker", buckets: int = 10, market: bool = False) -> DataFrame:
    """Per date: mean return of the top score decile minus the bottom one.
    Deciles are cross-sectional; ranks come from ``ranked``, so the firms of a date
    are spread over tasks.  ``market`` adds the equal-weighted return of all the
    date's firms (score or not)."""
    known = df.filter(F.col(ret).isNotNull())
    d = ranked(known.filter(F.col(score).isNotNull()).select(date_col, key, score, ret),
               [date_col], [F.col(score), F.col(key)])
    d = d.withColumn("decile", ntile(F.col("_rank"), F.col("_size"), buckets))
    out = (d.groupBy(date_col)
           .agg(F.avg(F.when(F.col("decile") == buckets, F.col(ret))).alias("top"),
                F.avg(F.when(F.col("decile") == 1, F.col(ret))).alias("bottom"),
                F.count(F.lit(1)).alias("n_firms")))
    if market:
        out = out.join(known.groupBy(date_col).agg(F.avg(ret).alias("market")), date_col, "left")
    return out.withColumn("spread", F.col("top") - F.col("bottom"))


def walk_forward(df: DataFrame, date_col: str = "date", train_frac: float = 0.7, n_folds: int = 5,
                 horizon: int = 0) -> DataFrame:
    """Expanding-window folds over the distinct dates: fold f tests the f-th
    block after the first ``train_frac`` of dates and trains on everything
    before it; with ``horizon`` > 0 the last ``horizon`` dates before the test
    block are purged from training (label overlap).  Output (fold, date, role)."""
    dates = df.select(date_col).distinct()
    # ranking distinct dates: one row per date, bounded by the calendar; the
    # date count comes from the same window (no second pass over ``df``)
    w = Window.orderBy(date_col)
    dates = dates.select(date_col, F.dense_rank().over(w).alias("_r"),
                         F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding,
                                                              Window.unboundedFollowing)).alias("_n"))
    cut = F.floor(F.col("_n") * train_frac)
    step = F.ceil((F.col("_n") - cut) / n_folds)
    folds = dates.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    start = cut + F.col("fold") * step
    role = (F.when((F.col("_r") > start) & (F.col("_r") <= start + step), F.lit("test"))
            .when(F.col("_r") <= start - horizon, F.lit("train")))
    out = folds.withColumn("role", role).filter(F.col("role").isNotNull())
    return out.select("fold", date_col, "role")


def fama_macbeth(df: DataFrame, y: str, x: str, date_col: str = "date") -> tuple[DataFrame, DataFrame]:
    """Per-date OLS slope/intercept (one regressor), then their time-series
    mean, standard error and t statistic."""
    ok = F.var_pop(x) > 0
    per = (df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
           .groupBy(date_col).agg(F.when(ok, F.regr_slope(y, x)).alias("slope"),
                                  F.when(ok, F.regr_intercept(y, x)).alias("intercept"),
                                  F.count(F.lit(1)).alias("n")))
    per = per.filter(F.col("slope").isNotNull())
    summary = per.agg(*[e for c in ("slope", "intercept") for e in (
        F.avg(c).alias(f"{c}_mean"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_se"),
        F.try_divide(F.avg(c), F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_t"))],
        F.count(F.lit(1)).alias("n_dates"))
    return per, summary


def newey_west(series: DataFrame, value: str, date_col: str = "date", lags: int = 5) -> DataFrame:
    """HAC (Bartlett) standard error of the mean of a time series."""
    w = Window.orderBy(date_col)  # one row per date: bounded by the calendar
    s = series.filter(F.col(value).isNotNull())
    # the series mean from the same ordered window (no second pass)
    mean = F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("_d", F.col(value) - mean)
    for l in range(1, lags + 1):
        s = s.withColumn(f"_l{l}", F.col("_d") * F.lag("_d", l).over(w))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(F.col("_d") * F.col("_d")).alias("g0")]
    aggs += [F.sum(f"_l{l}").alias(f"g{l}") for l in range(1, lags + 1)]
    a = s.agg(*aggs)
    lrv = F.col("g0")
    for l in range(1, lags + 1):
        lrv = lrv + 2 * (1 - l / (lags + 1)) * F.coalesce(F.col(f"g{l}"), F.lit(0.0))
    lrv = lrv / F.col("n")
    return a.select("n", "mean", F.sqrt(lrv / F.col("n")).alias("nw_se"),
                    F.try_divide(F.col("mean"), F.sqrt(lrv / F.col("n"))).alias("nw_t"))


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for an F(d1, d2) variable."""
    if f is None or not math.isfinite(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc_reg(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


GRANGER_OUT = ("{g} lag int, n long, ssr_restricted double, ssr_unrestricted double, f_stat double, "
               "df_num int, df_den int, p_value double, bic double, n_bic long, rank int, selected boolean")


def granger_moments(df: DataFrame, y: str, x: str, group_cols: list[str], order_col: str,
                    max_lag: int) -> DataFrame:
    """Cross-product moments of the Granger regressions of every lag 1..max_lag.

    Lags are the previous rows of each group's series (window partitioned by
    the group).  Each row is replicated once per lag it can serve (its first p
    lags of y and x present), the design is ``[1, y_1..y_L, x_1..x_L]`` with
    the lags beyond p zeroed, and one partial aggregate per (group, lag) sums
    the upper triangle of z z' and z y — so a group of any size leaves at most
    ``max_lag`` rows of (2L+1)(2L+2)/2 + 2L + 3 numbers."""
    w = Window.partitionBy(*group_cols).orderBy(order_col)
    whole = Window.partitionBy(*group_cols)
    base = df.select(*group_cols, order_col, F.col(y).cast("double").alias("_y"),
                     F.col(x).cast("double").alias("_x"))
    # the intercept takes up any shift, so the moments are taken about the group's means
    base = base.withColumns({c: F.col(c) - F.avg(c).over(whole) for c in ("_y", "_x")})
    base = base.select(*group_cols, "_y",
                       *[F.lag("_y", i).over(w).alias(f"_y{i}") for i in range(1, max_lag + 1)],
                       *[F.lag("_x", i).over(w).alias(f"_x{i}") for i in range(1, max_lag + 1)])
    base = base.filter(F.col("_y").isNotNull() & F.col("_y1").isNotNull() & F.col("_x1").isNotNull())
    # how many consecutive complete lags this row has
    depth = F.lit(1)
    for i in range(2, max_lag + 1):
        ok = F.lit(True)
        for j in range(2, i + 1):
            ok = ok & F.col(f"_y{j}").isNotNull() & F.col(f"_x{j}").isNotNull()
        depth = depth + F.when(ok, 1).otherwise(0)
    # each row serves every lag p <= depth on its own sample, and — when all
    # max_lag lags exist — every lag again on the common sample (the one BIC
    # compares lags on)
    entry = lambda common: (lambda l: F.struct(l.alias("lag"), F.lit(common).alias("common")))
    own = F.transform(F.sequence(F.lit(1), depth), entry(False))
    com = F.filter(F.transform(F.sequence(F.lit(1), F.lit(max_lag)), entry(True)),
                   lambda e: depth == F.lit(max_lag))
    rows = base.select("*", F.inline(F.concat(own, com)))
    z = [F.lit(1.0)]
    z += [F.when(F.col("lag") >= i, F.col(f"_y{i}")).otherwise(0.0) for i in range(1, max_lag + 1)]
    z += [F.when(F.col("lag") >= i, F.col(f"_x{i}")).otherwise(0.0) for i in range(1, max_lag + 1)]
    k = len(z)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("yy")]
    aggs += [F.sum(z[i] * z[j]).alias(f"zz_{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(z[i] * F.col("_y")).alias(f"zy_{i}") for i in range(k)]
    return rows.groupBy(*group_cols, "lag", "common").agg(*aggs)


def _granger_solve(pdf, group_cols: list[str], max_lag: int):
    """Per group: restricted / unrestricted SSR and F test of every lag on its
    own sample; BIC of the unrestricted model on the common sample."""
    import pandas as pd

    k = 2 * max_lag + 1

    def ssrs(r, p):
        """(restricted SSR, unrestricted SSR, rank): what elimination of the regressors, in order,
        leaves of y'y; a regressor of which nothing is left is collinear and takes nothing."""
        order = [*range(p + 1), *range(max_lag + 1, max_lag + p + 1)]
        m = np.zeros((len(order) + 1, len(order) + 1))
        for a, i in enumerate(order):
            for b, j in enumerate(order):
                m[a, b] = r[f"zz_{min(i, j)}_{max(i, j)}"]
            m[a, -1] = m[-1, a] = r[f"zy_{i}"]
        m[-1, -1] = r["yy"]
        size, rank, ssr_r = np.diag(m).copy(), 0, 0.0
        for step in range(len(order)):
            if rank < r["n"] and m[step, step] > COLLINEAR * size[step]:     # no more than one a row
                m = m - np.outer(m[:, step], m[step]) / m[step, step]
                rank += 1
            if step == p:
                ssr_r = m[-1, -1]
        none = COLLINEAR * size[-1]
        return (float(ssr_r) if ssr_r > none else 0.0), (float(m[-1, -1]) if m[-1, -1] > none else 0.0), rank

    recs = pdf.to_dict("records")
    common = {int(r["lag"]): r for r in recs if r["common"]}
    out = []
    for r in sorted((r for r in recs if not r["common"]), key=lambda r: r["lag"]):
        p, n = int(r["lag"]), int(r["n"])
        ssr_r, ssr_u, rank = ssrs(r, p)
        df_den = n - (2 * p + 1)
        if df_den > 0 and ssr_u > 0:
            f = (ssr_r - ssr_u) / p / (ssr_u / df_den)
            pv = f_sf(f, p, df_den)
        else:
            f = pv = float("nan")
        bic, n_bic = float("nan"), 0
        if p in common:
            c = common[p]
            n_bic = int(c["n"])
            _, ssr_c, _ = ssrs(c, p)
            if n_bic > 2 * p + 1 and ssr_c > 0:
                bic = n_bic * math.log(ssr_c / n_bic) + (2 * p + 1) * math.log(n_bic)
        out.append({**{g: r[g] for g in group_cols}, "lag": p, "n": n, "ssr_restricted": ssr_r,
                    "ssr_unrestricted": ssr_u, "f_stat": f, "df_num": p, "df_den": df_den,
                    "p_value": pv, "bic": bic, "n_bic": n_bic, "rank": rank})
    res = pd.DataFrame(out)
    if len(res):
        finite = res["bic"].replace([np.inf, -np.inf], np.nan)
        best = finite.idxmin() if finite.notna().any() else None
        res["selected"] = [i == best for i in res.index]
    return res


def granger_causality(df: DataFrame, y: str, x: str, group_cols: list[str] | None = None,
                      order_col: str = "date", max_lag: int = 5) -> DataFrame:
    """Does the past of ``x`` help predict ``y`` beyond the past of ``y``?

    For each group (e.g. firm; none = one series) and lag p = 1..max_lag: OLS of
    y on [1, y lags] (restricted) and [1, y lags, x lags] (unrestricted) over
    the rows with p complete lags, the SSR-based F test ((SSR_r − SSR_u)/p) /
    (SSR_u/(n − 2p − 1)) with its p-value.  Lags are compared on one common
    sample (rows with all max_lag lags, ``n_bic`` of them): the unrestricted
    model's BIC n·ln(SSR_u/n) + (2p+1)·ln n there; ``selected`` marks the
    lowest.  ``rank`` below 2p + 1 tells of collinear regressors.
    Rows are reduced to moments by one Spark aggregate; only those ≤ max_lag
    moment rows per group reach the Python solve (``applyInPandas``)."""
    groups = list(group_cols or [])
    src = df if groups else df.withColumn("_all", F.lit(1))
    keys = groups or ["_all"]
    mom = granger_moments(src, y, x, keys, order_col, max_lag)
    key_types = {f.name: f.dataType.simpleString() for f in src.schema.fields if f.name in keys}
    schema = GRANGER_OUT.format(g="".join(f"{g} {key_types[g]}, " for g in keys))
    out = mom.groupBy(*keys).applyInPandas(lambda pdf: _granger_solve(pdf, keys, max_lag), schema)
    return out.drop("_all") if not groups else out


def poisson_thresholds() -> list[float]:
    """P(X <= k) for Poisson(1), k = 0, 1, ... until it is 1.0 in double: a uniform u
    maps to the number of thresholds it reaches (its inverse CDF)."""
    out, cdf, k = [], math.exp(-1), 0
    while cdf < 1.0 and (not out or cdf > out[-1]):
        out.append(cdf)
        k += 1
        cdf += math.exp(-1) / math.factorial(k)
    return out


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, replicates: int = 200,
                      seed: int = 7) -> DataFrame:
    """Cluster (firm) bootstrap of a mean with Poisson(1) weights from a hash of
    (cluster, replicate, seed).  Values are pre-summed per cluster so a huge
    cluster costs one row; replicates are generated per cluster row (no join).
    Output: mean, bootstrap std and the 2.5 / 97.5 percentiles."""
    per = (df.filter(F.col(value).isNotNull()).groupBy(cluster)
           .agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n")))
    rep = per.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    key = F.concat_ws("|", F.col(cluster).cast("string"), F.col("replicate").cast("string"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))
    wgt = F.lit(0)
    for t in poisson_thresholds():
        wgt = wgt + F.when(u >= F.lit(t), 1).otherwise(0)
    rep = rep.withColumn("_w", wgt)
    # every replicate sees every cluster once, so the unweighted sums give the
    # point estimate in the same pass
    stat = (rep.groupBy("replicate")
            .agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_n"))).alias("stat"),
                 (F.sum("_s") / F.sum("_n")).alias("_point")))
    boot = stat.agg(F.max("_point").alias("mean"), F.stddev_samp("stat").alias("boot_std"),
                    F.percentile("stat", [0.025, 0.975]).alias("_ci"))
    return boot.select("mean", "boot_std", F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"))


#: A regressor counts as collinear if so much of it, relative to its size, is left.
COLLINEAR = 1e-9

#: Tasks that add up date-by-date matrices: each sends one (dates squared doubles) to the sum.
MATRIX_TASKS = 32


def _firm_rows(df: DataFrame, cols: list[str], entity: str, time: str, dates: DataFrame) -> DataFrame:
    """One row a firm: its cells (date index, rows, sums of the variables) and its raw cross products.
    Rows are summed by firm and date first, so a firm of any size has a row a date at most."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    cells = df.groupBy(entity, time).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(c) for c in cols],
        *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"c{i}_{j}") for i, j in pairs])
    placed = cells.join(F.broadcast(dates), F.col(time).eqNullSafe(F.col("_date")))
    return placed.groupBy(entity).agg(
        F.collect_list("_t").alias("t"), F.collect_list("n").alias("n"),
        *[F.collect_list(c).alias(c) for c in cols], *[F.sum(f"c{i}_{j}").alias(f"c{i}_{j}") for i, j in pairs])


def _firms(pdf, k: int):
    """(date indexes, rows, sums (dates x variables), cross products) of each firm row."""
    for r in pdf.itertuples(index=False):
        t, n = np.asarray(r.t, dtype=int), np.asarray(r.n, dtype=float)
        s = np.column_stack([np.asarray(getattr(r, f"v{i}"), dtype=float) for i in range(k)])
        cross = np.array([[getattr(r, f"c{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)], dtype=float)
        yield t, n, s, cross


def _date_effects(firms: DataFrame, k: int, n_dates: int, tol: float, most_rounds: int) -> tuple[np.ndarray, ...]:
    """The normal equations with the firm effects eliminated are a matrix over dates; returns the date
    effects that solve them, the date sums of the firm-demeaned variables and their cross products."""
    def partial(batches):
        outer = np.zeros((n_dates, n_dates))
        count, sums, cross = np.zeros(n_dates), np.zeros((n_dates, k)), np.zeros((k, k))
        for pdf in batches:
            weights = np.zeros((len(pdf), n_dates))
            for i, (t, n, s, c) in enumerate(_firms(pdf, k)):
                total = n.sum()
                mean = s.sum(axis=0) / total
                weights[i, t] = n / np.sqrt(total)
                count[t] += n
                sums[t] += s - np.outer(n, mean)
                cross += c - total * np.outer(mean, mean)
            outer += weights.T @ weights
        outer = np.diag(count) - outer
        rows = [(i, outer[i:i + 64].tobytes()) for i in range(0, n_dates, 64)]
        yield pd.DataFrame([*rows, (-1, sums.tobytes()), (-2, cross.tobytes())], columns=["part", "block"])

    def add(pdf):
        total = sum(np.frombuffer(b) for b in pdf["block"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "block": [total.tobytes()]})

    def solve(pdf):
        done = {part: np.frombuffer(block) for part, block in zip(pdf["part"], pdf["block"])}
        matrix = np.concatenate([done[i] for i in range(0, n_dates, 64)]).reshape(n_dates, n_dates)
        effects = _solve_dates(matrix, done[-1].reshape(n_dates, k), tol, most_rounds)
        return pd.DataFrame({"effects": [effects.tobytes()], "sums": [done[-1].tobytes()], "cross": [done[-2].tobytes()]})

    # the blocks of the sum meet in one task, which solves them: the calendar squared, whatever the panel
    kind = "part int, block binary"
    r = (firms.repartition(MATRIX_TASKS).mapInPandas(partial, kind).groupBy("part").applyInPandas(add, kind)
         .groupBy(F.lit("all")).applyInPandas(solve, "effects binary, sums binary, cross binary").first())
    return tuple(np.frombuffer(r[c]).reshape(-1, k) for c in ("effects", "sums", "cross"))


def _solve_dates(matrix: np.ndarray, sums: np.ndarray, tol: float, most_rounds: int) -> np.ndarray:
    """Date effects.  The matrix is singular along each set of dates that firms connect, so every
    set gets its own mean of zero as one more equation.  What a solve leaves over is solved again
    until it is below ``tol``, relative to the right-hand side; not a number if that is not reached."""
    n = len(matrix)
    label, sets = np.full(n, -1), 0
    for start in range(n):
        if label[start] < 0:
            label[start], queue = sets, [start]
            while queue:
                found = np.flatnonzero((matrix[queue.pop()] != 0) & (label < 0))
                label[found] = sets
                queue.extend(found)
            sets += 1
    member = label[:, None] == np.arange(sets)
    scale = np.diag(matrix)
    anchor = member @ (member / member.sum(axis=0)).T * np.where(scale > 0, scale, 1.0).mean()
    effects = np.linalg.solve(matrix + anchor, sums)
    size = np.abs(sums).max(axis=0)
    for _ in range(most_rounds):
        left = sums - matrix @ effects
        if (np.abs(left).max(axis=0) <= tol * size).all():
            return effects
        effects = effects + np.linalg.solve(matrix + anchor, left)
    return np.full_like(effects, np.nan)


def panel_fit(df: DataFrame, y: str, xs: list[str], entity: str = "ticker", time: str = "date",
              tol: float = 1e-10, most_rounds: int = 20) -> dict:
    """Two-way fixed-effects regression of ``y`` on several ``xs`` with entity-clustered errors:
    slopes, errors, n_obs, n_entities and rank.

    Exact for any panel: the firms are eliminated in closed form by one aggregate, and the date
    effects solve the system that is left, whose size is the calendar (a few thousand dates; one
    task solves it).  The panel is read three times: for the means, the firm rows, which are
    written to the checkpoint folder, and from these the matrix and the clustered errors.  Rows with
    a null variable take no part; a null firm or date is a level of its own.  Variables are scaled
    before the k x k solve; ``rank`` counts the regressors that are not collinear.  If refinement does
    not bring the system's residual below ``tol`` the fit fails."""
    cols = [f"v{i}" for i in range(len(xs) + 1)]
    k = len(cols)
    complete = F.lit(True)
    for c in (y, *xs):
        complete = complete & F.col(c).isNotNull()
    rows = df.filter(complete).select(F.col(entity).alias("_firm"), F.col(time).alias("_day"),
                                      *[F.col(c).cast("double").alias(n) for c, n in zip([y, *xs], cols)])
    base = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols]).first()
    if not base["n"]:
        return {"slopes": [None] * len(xs), "errors": [None] * len(xs), "n_obs": 0, "n_entities": 0, "rank": 0}
    centred = rows.select("_firm", "_day", *[(F.col(c) - F.lit(base[c])).alias(c) for c in cols])
    days = [r[0] for r in rows.select("_day").distinct().collect()]      # the calendar
    dates = df.sparkSession.createDataFrame(
        [(d, i) for i, d in enumerate(days)], T.StructType([T.StructField("_date", rows.schema["_day"].dataType),
                                                            T.StructField("_t", T.IntegerType())]))
    firms = cut_lineage(_firm_rows(centred, cols, "_firm", "_day", dates).drop("_firm"))
    effects, sums, cross = _date_effects(firms, k, len(days), tol, most_rounds)
    if np.isnan(effects).any():
        raise RuntimeError(f"fixed effects did not reach {tol} in {most_rounds} rounds")
    moment = cross - sums.T @ effects
    gone = np.diag(moment)[1:] <= COLLINEAR * np.diag(cross)[1:]           # the levels explain the regressor
    moment[1:, 1:][gone] = moment[1:, 1:][:, gone] = 0.0
    moment[1:, 0][gone] = 0.0
    scale = np.sqrt(np.where(gone, 1.0, np.diag(moment)[1:]))
    xx, xy = moment[1:, 1:] / np.outer(scale, scale), moment[1:, 0] / scale
    rank = int(np.linalg.matrix_rank(xx, tol=COLLINEAR))
    inverse = np.linalg.pinv(xx, rcond=COLLINEAR, hermitian=True)
    slopes = inverse @ xy / scale
    weights = np.concatenate([[1.0], -slopes])

    def meat(batches):
        total, n = np.zeros((k - 1, k - 1)), 0
        for pdf in batches:
            for t, rows_, s, c in _firms(pdf, k):
                own = (s - rows_[:, None] * effects[t]).sum(axis=0) / rows_.sum()
                fitted = own + effects[t]
                inner = c - fitted.T @ s - s.T @ fitted + fitted.T @ (rows_[:, None] * fitted)
                score = inner[1:] @ weights
                total += np.outer(score, score)
                n += 1
        yield pd.DataFrame({"n": [n], "meat": [total.tobytes()]})

    parts = firms.mapInPandas(meat, "n bigint, meat binary").collect()   # k x k numbers a task
    m = sum(np.frombuffer(r["meat"]).reshape(k - 1, k - 1) for r in parts) / np.outer(scale, scale)
    errors = np.sqrt(np.maximum(np.diag(inverse @ m @ inverse), 0.0)) / scale
    return {"slopes": [float(v) for v in slopes], "errors": [float(e) for e in errors], "n_obs": int(base["n"]),
            "n_entities": sum(r["n"] for r in parts), "rank": rank}


def panel_ols_fe(df: DataFrame, y: str, x: str, entity: str = "ticker", time: str = "date",
                 tol: float = 1e-10) -> DataFrame:
    """One regressor: (slope, cluster_se, n_obs, n_entities)."""
    f = panel_fit(df, y, [x], entity, time, tol)
    return df.sparkSession.createDataFrame([(f["slopes"][0], f["errors"][0], f["n_obs"], f["n_entities"])],
                                           "slope double, cluster_se double, n_obs bigint, n_entities bigint")


def panel_coefficients(df: DataFrame, y: str, xs: list[str], entity: str = "ticker", time: str = "date",
                       tol: float = 1e-10) -> DataFrame:
    """Several regressors: (term, slope, cluster_se, t, n_obs, n_entities), one row each."""
    f = panel_fit(df, y, xs, entity, time, tol)
    rows = [(x, b, e, b / e if e else None, f["n_obs"], f["n_entities"]) for x, b, e in zip(xs, f["slopes"], f["errors"])]
    return df.sparkSession.createDataFrame(
        rows, "term string, slope double, cluster_se double, t double, n_obs bigint, n_entities bigint")


def fama_macbeth_multi(df: DataFrame, y: str, xs: list[str], date_col: str = "date") -> DataFrame:
    """Fama-MacBeth on several regressors: per date a cross-sectional OLS, then the
    mean, standard error and t of each coefficient over the dates.

    A date is reduced to centred moments by one aggregate (its means are joined back
    first); only that one row per date reaches the k x k solve.  Dates whose
    regressors are collinear, or with too few firms, are left out."""
    k = len(xs)
    complete = F.col(date_col).isNotNull()
    for c in (y, *xs):
        complete = complete & F.col(c).isNotNull()
    cols = [f"_v{i}" for i in range(k + 1)]
    d = df.filter(complete).select(F.col(date_col).alias("_d"), *[F.col(c).cast("double").alias(n) for c, n in zip([y, *xs], cols)])
    means = d.groupBy(F.col("_d").alias("_md")).agg(*[F.avg(c).alias(f"m{c}") for c in cols])
    centred = d.join(means, F.col("_d") == F.col("_md"))
    moments_ = centred.groupBy("_d").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(f"m{c}").alias(f"m{c}") for c in cols],
        *[F.sum((F.col(cols[i]) - F.col(f"m{cols[i]}")) * (F.col(cols[j]) - F.col(f"m{cols[j]}"))).alias(f"c{i}_{j}")
          for i in range(k + 1) for j in range(i, k + 1)])

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                m = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
                scale = np.sqrt(np.maximum(np.diag(m)[1:], 0.0))
                if r["n"] <= k or (scale == 0).any():
                    continue
                xx = m[1:, 1:] / np.outer(scale, scale)
                if np.linalg.matrix_rank(xx, tol=1e-9) < k:
                    continue
                b = np.linalg.solve(xx, m[1:, 0] / scale) / scale
                rows.append((float(r[f"m{cols[0]}"] - sum(b[i] * r[f"m{cols[i + 1]}"] for i in range(k))), *map(float, b)))
            yield pd.DataFrame(rows, columns=["b0", *[f"b{i + 1}" for i in range(k)]], dtype="float64")

    per = moments_.mapInPandas(solve, ", ".join(f"b{i} double" for i in range(k + 1)))
    long = per.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"b{i}").alias("b"))
                                          for i, t in enumerate(["intercept", *xs])])).alias("_r")).select("_r.*")
    se = F.stddev_samp("b") / F.sqrt(F.count("b"))
    return long.groupBy("term").agg(F.avg("b").alias("mean"), se.alias("se"), F.try_divide(F.avg("b"), se).alias("t"),
                                    F.count("b").alias("n_dates"))


def out_of_sample(df: DataFrame, features: list[str], target: str, folds: DataFrame, date_col: str = "date") -> DataFrame:
    """Per fold of (fold, date, role): OLS on the fold's train dates, scored on its test
    dates: (fold, n_train, n_test, mse, mae, hit_rate).

    The folds table has a row per fold and date (calendar-sized) and is broadcast. The rows are
    kept once, whatever the number of folds; on one regressor all fits are one pass over them and
    all scores another, several regressors take the passes of ``fit_ols`` a fold."""
    spark = df.sparkSession
    parts = F.broadcast(cut_lineage(folds.select("fold", date_col, "role")))
    complete = F.lit(True)
    for c in (target, *features):
        complete = complete & F.col(c).isNotNull()
    rows = cut_lineage(df.filter(complete).select(date_col, target, *features))
    train, test = (rows.join(parts.filter(F.col("role") == role), date_col) for role in ("train", "test"))
    wanted = sorted(r["fold"] for r in parts.select("fold").distinct().collect())
    if len(features) == 1:
        fits = fit_ols_by(train, "fold", features[0], target)
        models = [fits.get(fold) or fit_ols(rows.limit(0), features, target) for fold in wanted]     # the latter raises
    else:
        models = [fit_ols(train.filter(F.col("fold") == fold), features, target) for fold in wanted]
    names = [f"_b{i}" for i in range(len(features) + 1)]
    fitted = F.broadcast(spark.createDataFrame(
        [(int(fold), m.n, *m.coefficients) for fold, m in zip(wanted, models)],
        "_fold int, n_train bigint, " + ", ".join(f"{n} double" for n in names)))
    predicted = F.col("_b0")
    for n, c in zip(names[1:], features):
        predicted = predicted + F.col(c).cast("double") * F.col(n)
    err = F.col(target) - F.col("_p")
    scores = (test.join(fitted, F.col("fold") == F.col("_fold")).withColumn("_p", predicted).groupBy("fold")
              .agg(F.count(F.lit(1)).alias("n_test"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
                   F.avg(F.when(F.signum(target) == F.signum("_p"), 1.0).otherwise(0.0)).alias("hit_rate")))
    return fitted.join(scores, F.col("_fold") == F.col("fold"), "left").select(
        F.col("_fold").alias("fold"), "n_train", F.coalesce("n_test", F.lit(0).cast("bigint")).alias("n_test"), "mse", "mae", "hit_rate")
