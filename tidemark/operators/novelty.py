"""Text vectors pooled per firm-day and novelty against the firm's own history.

Plan shape: Aggregate(ticker, date) → Window(partition ticker, range −30..−1
days) → Project.  Raw rows are always reduced to one row per firm-day before
the window, so a window partition holds at most one row per calendar day of
one firm, and the history list of a row holds at most ``window_days`` vectors.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed import NOVELTY_MIN_HISTORY, NOVELTY_WINDOW_DAYS
from tidemark.functions.models import hashed_encoder
from tidemark.functions.plan import materialize
from tidemark.functions.text import fill_text, is_blank
from tidemark.functions.vectors import cosine, vec_scale, vec_sum
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.ranks import ranked

EPOCH = date(1970, 1, 1)


def encode(df: DataFrame, text_col: str = "text", encoder=None, dim: int = 64,
           out: str = "embedding") -> DataFrame:
    """Append a text vector (default: hashed bag of words, ``dim`` buckets)."""
    enc = encoder or (lambda c: hashed_encoder(c, dim))
    return materialize(df, **{out: enc(fill_text(F.col(text_col)))})


def firm_day_embedding(df: DataFrame, keys=("ticker", "date"), emb_col: str = "embedding",
                       text_col: str = "text", how: str = "mean", dim: int = 64,
                       extra_aggs: list[Column] | None = None) -> DataFrame:
    """One vector per firm-day over its non-blank texts: element-wise mean,
    text-length-weighted mean or max.  Also text_length (all texts' characters),
    num_paragraphs (all texts) and n_valid (non-blank texts).  A firm-day whose
    texts are all blank gets ``embedding`` NULL.  NULL keys are dropped.

    Written as ``dim`` ordinary aggregates so the group-by runs as a partial
    (map-side) hash aggregate.  ``extra_aggs`` ride along in the same pass."""
    keys = list(keys)
    # the blank test and the length run once per row in a projection below the
    # aggregate, not once per vector component inside it
    df = df.withColumns({"_ok": ~is_blank(F.col(text_col)),
                         "_len": F.length(fill_text(F.col(text_col)))})
    ok = F.col("_ok")
    e = F.col(emb_col).cast("array<double>")
    if how == "mean":
        comps = [F.avg(F.when(ok, e[i])) for i in range(dim)]
    elif how == "weighted_mean":
        w = F.when(ok, F.col("_len").cast("double"))
        comps = [F.try_divide(F.sum(w * e[i]), F.sum(w)) for i in range(dim)]
    elif how == "max_pool":
        comps = [F.max(F.when(ok, e[i])) for i in range(dim)]
    else:
        raise ValueError(f"Unsupported aggregation method: {how}")
    out = (df.filter(F.greatest(*[F.col(k).isNull() for k in keys]) == F.lit(False))
           .groupBy(*keys)
           .agg(F.array(*comps).alias("_v"),
                F.sum("_len").cast("int").alias("text_length"),
                F.count(F.lit(1)).cast("int").alias("num_paragraphs"),
                F.count(F.when(ok, 1)).cast("int").alias("n_valid"),
                *(extra_aggs or [])))
    return (out.withColumn(emb_col, F.when(F.col("n_valid") > 0, F.col("_v"))).drop("_v"))


def check_window(window_days: int, min_history: int) -> None:
    if window_days < 1 or min_history < 1:
        raise ValueError(f"window_days and min_history must be at least 1, not {window_days} and {min_history}")


def _day_window(window_days: int, key: str = "ticker"):
    return (Window.partitionBy(key).orderBy(F.col("_day"))
            .rangeBetween(-window_days, -1))


def novelty(firm_days: DataFrame, key: str = "ticker", date_col: str = "date",
            emb_col: str = "embedding", window_days: int = NOVELTY_WINDOW_DAYS,
            min_history: int = NOVELTY_MIN_HISTORY) -> DataFrame:
    """Novelty per firm-day.

    History = stored vectors of the same firm dated in [d − window_days, d)
    (days whose texts were all blank are not stored).  Score: all-blank day →
    0.0; fewer than ``min_history`` history days → 0.5; otherwise
    1 − max(0, cosine(today, mean of history)).  Adds ``window_size`` (history
    days) and ``rolling_mean_embedding`` (when the history is long enough)."""
    check_window(window_days, min_history)
    day = F.datediff(F.col(date_col), F.lit(EPOCH))
    stored = F.when(F.col(emb_col).isNotNull(), F.col(emb_col))
    w = _day_window(window_days, key)
    out = (firm_days.withColumn("_day", day)
           .withColumn("_hist", F.collect_list(stored).over(w)))
    n = F.size("_hist")
    # the vector sum is computed once; score and rolling mean read the column
    out = materialize(out, _hsum=vec_sum(F.col("_hist")))
    hist_sum = F.col("_hsum")
    score = (F.when(F.col(emb_col).isNull(), F.lit(0.0))
             .when(n < min_history, F.lit(0.5))
             .otherwise(F.lit(1.0) - F.greatest(F.lit(0.0), cosine(F.col(emb_col), hist_sum))))
    return (out.withColumn("window_size", n.cast("int"))
            .withColumn("novelty_score", score)
            .withColumn("rolling_mean_embedding",
                        F.when(F.col(emb_col).isNotNull() & (F.col("window_size") >= min_history),
                               vec_scale(F.col("_hsum"), F.lit(1.0) / F.col("window_size"))))
            .drop("_day", "_hist", "_hsum"))


def novelty_rows(rows: DataFrame, key: str = "ticker", date_col: str = "date",
                 emb_col: str = "embedding", text_col: str = "text", dim: int = 64,
                 window_days: int = NOVELTY_WINDOW_DAYS,
                 min_history: int = NOVELTY_MIN_HISTORY) -> DataFrame:
    """Novelty of every row on its own: each earlier non-blank row of the firm
    in the window is one history item.  Rows are first summed per firm-day
    (vector sum + count), the window runs over firm-days and the result is
    joined back on (ticker, date)."""
    check_window(window_days, min_history)
    ok = ~is_blank(F.col(text_col))
    e = F.col(emb_col).cast("array<double>")
    daily = (rows.filter(ok & F.col(key).isNotNull() & F.col(date_col).isNotNull())
             .groupBy(key, date_col)
             .agg(F.array(*[F.sum(e[i]) for i in range(dim)]).alias("_s"),
                  F.count(F.lit(1)).alias("_c")))
    w = _day_window(window_days, key)
    hist = (daily.withColumn("_day", F.datediff(F.col(date_col), F.lit(EPOCH)))
            .withColumn("_h", F.collect_list(F.struct("_s", "_c")).over(w))
            .select(key, date_col,
                    vec_sum(F.transform("_h", lambda x: x["_s"])).alias("_hsum"),
                    F.aggregate("_h", F.lit(0).cast("bigint"), lambda a, x: a + x["_c"]).alias("_hn")))
    out = rows.join(hist, [key, date_col], "left")
    n = F.coalesce(F.col("_hn"), F.lit(0))
    score = (F.when(~ok, F.lit(0.0))
             .when(n < min_history, F.lit(0.5))
             .otherwise(F.lit(1.0) - F.greatest(F.lit(0.0), cosine(F.col(emb_col), F.col("_hsum")))))
    return out.withColumns({"novelty_score": score, "window_size": n.cast("int")}).drop("_hsum", "_hn")


def attach_group_scores(rows: DataFrame, scores: DataFrame, keys=("ticker", "date"),
                        cols=("novelty_score",)) -> DataFrame:
    """Copy firm-day scores to each of the firm-day's rows (plain equality:
    rows with NULL keys keep NULL)."""
    return rows.join(scores.select(*keys, *cols), list(keys), "left")


def stored_novelty(scored: DataFrame, created_at: datetime,
                   min_history: int = NOVELTY_MIN_HISTORY) -> DataFrame:
    """The rows persisted to the score table: history long enough."""
    return (scored.filter(F.col("embedding").isNotNull() & (F.col("window_size") >= min_history))
            .select("ticker", "date", F.col("novelty_score").cast("float").alias("novelty_score"),
                    F.col("rolling_mean_embedding").cast("array<float>").alias("rolling_mean_embedding"),
                    "window_size", F.lit(created_at).alias("created_at")))


def novelty_where(df: DataFrame, ticker: str | None = None, start: date | None = None,
                  end: date | None = None) -> DataFrame:
    """Optional conjunctive predicates; dates inclusive on both ends."""
    if ticker:
        df = df.filter(F.col("ticker") == ticker)
    if start:
        df = df.filter(F.col("date") >= F.lit(start))
    if end:
        df = df.filter(F.col("date") <= F.lit(end))
    return df


def novelty_statistics(df: DataFrame, score_col: str = "novelty_score") -> DataFrame:
    """count, mean, sample std, min, max, distinct tickers, first/last date."""
    s = F.col(score_col)
    return df.agg(F.count(F.lit(1)).alias("count"), F.avg(s).alias("mean_novelty"),
                  F.stddev_samp(s).alias("std_novelty"), F.min(s).alias("min_novelty"),
                  F.max(s).alias("max_novelty"), F.count_distinct("ticker").alias("unique_tickers"),
                  F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def novelty_time_series(df: DataFrame, score_col: str = "novelty_score", window: int | None = None,
                        key: str = "ticker", date_col: str = "date") -> DataFrame:
    """Per-ticker ordered series with an optional full-window rolling mean."""
    out = df.select(key, date_col, score_col)
    if window:
        w = Window.partitionBy(key).orderBy(date_col).rowsBetween(-(window - 1), 0)
        s = F.col(score_col)
        out = out.withColumn(f"{score_col}_rolling", F.when(F.count(s).over(w) == window, F.avg(s).over(w)))
    return out


def rank_percentiles(df: DataFrame, value: str, group: str, out: str) -> DataFrame:
    """pandas ``rank(pct=True) * 100`` inside each group: the average rank of ties among
    the non-null values (ascending) divided by their count; NULL stays NULL.

    A tie's average rank is the middle of its first and last row number, a partial
    aggregate per (group, value), so neither a group nor a tie is gathered."""
    known = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"))
    ties = (ranked(known, ["_g"], [F.col("_v")]).groupBy("_g", "_v")
            .agg(((F.min("_rank") + F.max("_rank")) / 2.0 / F.max("_size") * 100.0).alias(out)))
    return df.join(ties, F.col(group).eqNullSafe(F.col("_g")) & (F.col(value) == F.col("_v")), "left").drop("_g", "_v")


def cross_sectional_novelty(df: DataFrame, on: date | None = None, score_col: str = "novelty_score",
                            date_col: str = "date") -> DataFrame:
    """Rows of one date (or every date at once) with the within-date percentile."""
    if on is not None:
        df = df.filter(F.col(date_col) == F.lit(on))
    return rank_percentiles(df, score_col, date_col, "novelty_percentile")


def cross_section_stats(df: DataFrame, score_col: str = "novelty_score", date_col: str = "date") -> DataFrame:
    """Per date: mean, median, sample std, min, max and row count.  The median
    comes from ``exact_quantiles`` (no date is gathered into one task)."""
    s = F.col(score_col)
    rows = df.filter(F.col(date_col).isNotNull())
    moments = rows.groupBy(date_col).agg(F.avg(s).alias("mean_novelty"), F.stddev_samp(s).alias("std_novelty"),
                                         F.min(s).alias("min_novelty"), F.max(s).alias("max_novelty"),
                                         F.count(F.lit(1)).alias("count"))
    med = exact_quantiles(rows, score_col, [0.5], [date_col]).select(date_col, F.col("quantile").alias("median_novelty"))
    return (moments.join(med, date_col, "left")
            .select(date_col, "mean_novelty", "median_novelty", "std_novelty", "min_novelty", "max_novelty", "count"))
