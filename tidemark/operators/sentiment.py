"""Sentiment scoring and its aggregations.

The default scorer is a Column expression (no Python in the hot path).  A real
model plugs in through ``scorer=`` — either a Column -> struct function or an
iterator pandas UDF from ``functions.models.pandas_scorer``; with
``dedupe=True`` identical texts are scored once and joined back.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed import NEGATIVE_KEYWORDS, NEUTRAL_SCORES, POSITIVE_KEYWORDS
from tidemark.functions.models import class_scores, normalize_for_keywords
from tidemark.functions.plan import materialize
from tidemark.operators.quantiles import exact_quantiles
from tidemark.functions.text import collapse_ws, count_contained, fill_text, is_blank
from tidemark.session import cut_lineage

CLASSES = ("positive", "negative", "neutral")


def argmax_label(pos: Column, neg: Column, neu: Column) -> Column:
    """Label of the largest class score; ties resolve positive > negative > neutral."""
    return (F.when((pos >= neg) & (pos >= neu), F.lit("positive"))
            .when(neg >= neu, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def sentiment_columns(text: Column, scores: Column, blank: Column | None = None) -> dict:
    """Name -> Column for label, positive, negative, neutral, compound from a
    materialised ``scores`` struct(positive, negative, neutral).  Blank text
    (NULL or whitespace only) gets the fixed neutral row; pass a materialised
    ``blank`` flag to avoid re-running the whitespace test per reference."""
    if blank is None:
        blank = is_blank(fill_text(text))
    vals = {k: F.when(blank, F.lit(NEUTRAL_SCORES[k])).otherwise(scores[k].cast("double"))
            for k in CLASSES}
    return {
        "label": argmax_label(vals["positive"], vals["negative"], vals["neutral"]),
        **vals,
        "compound": vals["positive"] - vals["negative"],
    }


def _scores(df: DataFrame, text: Column, scorer, normalized: Column | None, positive: list[str],
            negative: list[str]) -> DataFrame:
    """Append the class-score struct ``_sc`` and the blank flag ``_blank``.

    Everything expensive — the keyword counts (default scorer) or the model
    call, and the whitespace test — is computed once behind a Generate
    barrier; the class scores and the label only do arithmetic on those
    columns.  (Inlined, each count would be re-evaluated in every class score
    and the blank regex in every branch of the label.)"""
    blank = is_blank(fill_text(text))
    if scorer is not None:
        return materialize(df, _sc=scorer(fill_text(text)), _blank=blank)
    if normalized is None:
        df = df.withColumn("_snorm", normalize_for_keywords(fill_text(text)))
        normalized = F.col("_snorm")
    counts = F.struct(count_contained(normalized, positive).alias("p"),
                      count_contained(normalized, negative).alias("n"))
    df = materialize(df, _pn=counts, _blank=blank).drop("_snorm")
    return df.withColumn("_sc", class_scores(F.col("_pn.p"), F.col("_pn.n"))).drop("_pn")


def score_sentiment(df: DataFrame, text_col: str = "text", scorer=None,
                    prefix: str = "sentiment_", dedupe: bool = False,
                    normalized_col: str | None = None, positive: list[str] | None = None,
                    negative: list[str] | None = None) -> DataFrame:
    """Append ``{prefix}label/positive/negative/neutral/compound``; ``positive`` and
    ``negative`` replace the default keyword lists.

    ``normalized_col`` may name an existing lower-cased, whitespace-collapsed
    copy of the text (shared with other keyword operators).  ``dedupe=True`` is
    meant for expensive model scorers: distinct texts (keyed by md5) are scored
    once and joined back; AQE's skew join splits a hot text."""
    lists = (POSITIVE_KEYWORDS if positive is None else positive, NEGATIVE_KEYWORDS if negative is None else negative)
    if not dedupe:
        norm = F.col(normalized_col) if normalized_col else None
        tmp = _scores(df, F.col(text_col), scorer, norm, *lists)
        cols = sentiment_columns(F.col(text_col), F.col("_sc"), F.col("_blank"))
        return tmp.withColumns({prefix + k: v for k, v in cols.items()}).drop("_sc", "_blank")
    key = "_text_md5"
    keyed = df.withColumn(key, F.md5(fill_text(F.col(text_col))))
    distinct = keyed.groupBy(key).agg(F.any_value(fill_text(F.col(text_col))).alias("_t"))
    distinct = _scores(distinct, F.col("_t"), scorer, None, *lists)
    cols = sentiment_columns(F.col("_t"), F.col("_sc"), F.col("_blank"))
    scored = distinct.select(key, *[v.alias(prefix + k) for k, v in cols.items()])
    return keyed.join(scored, key, "left").drop(key)


def aggregate_sentiment(df: DataFrame, keys: list[str], weight_col: str | None = None,
                        prefix: str = "sentiment_", key_set: DataFrame | None = None) -> DataFrame:
    """Weighted mean of each class score and compound per group (weights are
    normalised by the group total; a missing score counts as 0); label by the
    largest mean with positive > negative > neutral.  A zero total weight gives
    NULL scores.  Groups of ``key_set`` without rows get the neutral row."""
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    total = F.sum(w)
    aggs = [F.try_divide(F.sum(w * F.coalesce(F.col(prefix + k), F.lit(0.0))), total).alias(k)
            for k in (*CLASSES, "compound")]
    out = df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_texts"))
    if key_set is not None:
        out = key_set.select(*keys).distinct().join(out, keys, "left")
        out = out.withColumns({k: F.coalesce(F.col(k), F.lit(NEUTRAL_SCORES[k]))
                               for k in (*CLASSES, "compound")})
        out = out.withColumn("n_texts", F.coalesce(F.col("n_texts"), F.lit(0)))
    return out.withColumn("label", argmax_label(F.col("positive"), F.col("negative"), F.col("neutral")))


def sentiment_time_series(df: DataFrame, date_col: str, value_col: str, how: str = "mean",
                          window: int | None = None) -> DataFrame:
    """Per-date mean / median / sum (sum of an all-NULL date is 0), with an
    optional rolling mean over the last ``window`` dates present.

    The rolling step runs on the per-date aggregate, whose size is bounded by
    the calendar (one row per date), never on raw rows."""
    v = F.col(value_col)
    rows = df.filter(F.col(date_col).isNotNull())
    if how == "mean":
        agg = F.avg(v)
    elif how == "median":
        agg = None
    elif how == "sum":
        agg = F.coalesce(F.sum(v), F.lit(0.0))
    else:
        raise ValueError(f"Unsupported aggregation: {how}")
    if agg is not None:
        out = rows.groupBy(date_col).agg(agg.cast("double").alias(value_col))
    else:
        # exact median without gathering a (possibly hot) date into one task;
        # dates whose values are all NULL keep a NULL median; the values are computed once for
        # the dates and the medians (what makes them may be a scorer over whole texts)
        rows = cut_lineage(rows.select(date_col, value_col))
        med = exact_quantiles(rows, value_col, [0.5], [date_col]).select(date_col, F.col("quantile").alias(value_col))
        out = rows.select(date_col).distinct().join(med, date_col, "left")
    if window:
        w = Window.orderBy(date_col).rowsBetween(-(window - 1), 0)
        out = out.withColumn(f"{value_col}_rolling",
                             F.when(F.count(v).over(w) == window, F.avg(v).over(w)))
    return out


def label_counts(df: DataFrame, label_col: str = "sentiment_label",
                 compound_col: str = "sentiment_compound") -> DataFrame:
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"),
                                     F.avg(compound_col).alias("mean_compound"))


def token_windows(df: DataFrame, text_col: str = "text", size: int = 64,
                  id_cols: tuple = ()) -> DataFrame:
    """Cut each whole text into consecutive windows of at most ``size``
    whitespace tokens (one row per window, nothing dropped)."""
    words = F.split(collapse_ws(fill_text(F.col(text_col))), " ")
    n = F.when(F.length(collapse_ws(fill_text(F.col(text_col)))) == 0, F.lit(0)).otherwise(F.size(words))
    out = df.select(*id_cols, words.alias("_w"), n.alias("_n"))
    out = out.select(*id_cols, "_w",
                     F.explode(F.sequence(F.lit(0),
                                          F.greatest(F.ceil(F.col("_n") / size).cast("int") - 1, F.lit(0))))
                     .alias("window_id"), "_n")
    return (out.filter(F.col("_n") > 0)
            .select(*id_cols, "window_id",
                    F.array_join(F.slice("_w", F.col("window_id") * size + 1, size), " ").alias("window_text"),
                    F.least(F.lit(size), F.col("_n") - F.col("window_id") * size).alias("n_tokens")))
