"""Firm-day feature panel: aspect sentiment, novelty, shocks, factors and the
look-ahead-safe alignment to the next trading day's return."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed import DEFAULT_LEXICON
from tidemark.operators import aspects as A
from tidemark.operators import filings as FI
from tidemark.operators import novelty as NV
from tidemark.operators import prices as PR
from tidemark.operators import sentiment as S

EPOCH = NV.EPOCH


def trade_date_asof(events: DataFrame, bars: DataFrame, key: str = "ticker",
                    event_date: str = "date", bar_date: str = "date") -> DataFrame:
    """Map every (ticker, event date) to the first bar date strictly after it.

    Events are first reduced to distinct (ticker, day) keys, so however many
    events a hot ticker has, the window partition holds at most one row per
    calendar day for events plus one per bar.  The window runs newest-first
    with a growing frame (``unboundedPreceding .. -1``), i.e. a running min,
    linear in the partition size.  Output: (ticker, event_date, trade_date)."""
    keys = events.select(F.col(key).alias(key), F.col(event_date).alias("_d")).distinct()
    days = bars.select(F.col(key).alias(key), F.col(bar_date).alias("_d")).distinct()
    u = (keys.withColumn("_bar", F.lit(None).cast("date")).withColumn("_ev", F.lit(True))
         .unionByName(days.withColumn("_bar", F.col("_d")).withColumn("_ev", F.lit(False))))
    u = u.withColumn("_day", F.datediff(F.col("_d"), F.lit(EPOCH)))
    w = Window.partitionBy(key).orderBy(F.col("_day").desc()).rangeBetween(Window.unboundedPreceding, -1)
    out = u.withColumn("trade_date", F.min("_bar").over(w)).filter(F.col("_ev"))
    return out.select(key, F.col("_d").alias("event_date"), "trade_date")


def align_next_trade_day(events: DataFrame, bars: DataFrame, key: str = "ticker",
                         date_col: str = "date") -> DataFrame:
    """Attach ``trade_date`` to every event row (equi-join on the as-of map)."""
    m = trade_date_asof(events, bars, key, date_col)
    return events.join(m.withColumnRenamed("event_date", date_col), [key, date_col], "left")


def attach_next_bar(panel: DataFrame, bars: DataFrame, fields: list[str], key: str = "ticker",
                    date_col: str = "date") -> DataFrame:
    """For every panel row, the first bar strictly after its date: adds
    ``trade_date`` and the bar's ``fields``.

    One pass, no join back: panel rows and bar rows (carrying their fields in
    one struct) are unioned and a per-key window running newest-first takes
    the minimum bar struct over strictly later days.  Both sides are
    one-row-per-key-day, so a window partition is bounded by the calendar
    however skewed the raw rows are, and each input is read once.  The panel
    must be such an aggregate; raw event rows go through
    ``align_next_trade_day``, which reduces them to distinct keys first."""
    bar = F.struct(F.col(date_col).alias("trade_date"), *[F.col(c) for c in fields])
    b = bars.select(key, date_col, bar.alias("_bar"), F.lit(False).alias("_ev"))
    p = panel.withColumn("_ev", F.lit(True))
    u = p.unionByName(b, allowMissingColumns=True)
    w = (Window.partitionBy(key).orderBy(F.datediff(F.col(date_col), F.lit(EPOCH)).desc())
         .rangeBetween(Window.unboundedPreceding, -1))
    out = u.withColumn("_next", F.min("_bar").over(w)).filter(F.col("_ev"))
    return out.select(*panel.columns, "_next.trade_date", *[F.col(f"_next.{c}").alias(c) for c in fields])


def equal_weighted_index(bars: DataFrame, ret_col: str = "return_1d", date_col: str = "date") -> DataFrame:
    """Mean return over firms per date (partial aggregate per date)."""
    return bars.groupBy(date_col).agg(F.avg(ret_col).alias("market_return"),
                                      F.count(ret_col).alias("n_firms"))


def bar_factors(bars: DataFrame) -> DataFrame:
    """Per bar: its return (the alignment target) and factors known at the
    previous close (momentum 20, volume ratio 20), plus the market return.

    The market return is a partial aggregate per date joined back as a broadcast:
    one row per trading day, bounded by the calendar, however many firms there are."""
    b = PR.calculate_returns(bars, "close", [1, 20])
    b = PR.technical_indicators(b)
    w = Window.partitionBy("ticker").orderBy("date")
    b = b.select("ticker", "date", "return_1d",
                 F.lag("return_20d").over(w).alias("momentum_20d"),
                 F.lag("volume_ratio").over(w).alias("volume_ratio"))
    market = b.groupBy("date").agg(F.avg("return_1d").alias("market_return"))
    return b.join(F.broadcast(market), "date", "left")


def attach_factors(panel: DataFrame, firm_factors: DataFrame | None = None, market_factors: DataFrame | None = None,
                   key: str = "ticker", date_col: str = "date") -> DataFrame:
    """Supplied factor tables merged onto a panel: ``firm_factors`` (size, book-to-market,
    ...) by (ticker, date), ``market_factors`` by date (one row per date, bounded by the
    calendar: broadcast).  Rows without a factor row keep NULLs; a key may occur once
    in a factor table."""
    out = panel
    if firm_factors is not None:
        out = out.join(firm_factors, [key, date_col], "left")
    if market_factors is not None:
        out = out.join(F.broadcast(market_factors), date_col, "left")
    return out


def paragraph_scores(texts: DataFrame, vectors: dict, lexicon: dict = DEFAULT_LEXICON,
                     dim: int = 64, id_cols=("doc_id", "ticker", "date")) -> DataFrame:
    """Paragraph rows with vector, aspect map and sentiment columns."""
    paras = FI.split_paragraphs(texts, "text", id_cols=id_cols)
    # paragraphs are whitespace-collapsed already, so one lower-cased copy
    # serves both the aspect keywords and the sentiment keywords
    enc = NV.encode(paras, "paragraph", dim=dim).withColumn("_low", F.lower("paragraph"))
    asp = A.detect_aspects(enc, "paragraph", lexicon, vectors, "embedding", lowered_col="_low")
    return S.score_sentiment(asp, "paragraph", normalized_col="_low").drop("_low")


def feature_panel(texts: DataFrame, bars: DataFrame, vectors: dict,
                  lexicon: dict = DEFAULT_LEXICON, dim: int = 64) -> DataFrame:
    """Firm-day features aligned to the next trading day.

    sentiment_score = mean compound of the day's paragraphs; <a>_sentiment =
    mean compound of the paragraphs carrying aspect a (0 when absent);
    novelty_score from the firm's 30-day history; <a>_shock = <a>_sentiment x
    novelty.  trade_date = first bar strictly after the text date;
    forward_return = that bar's return; momentum_20d / volume_ratio as of the
    bar before it; market_return = equal-weighted return on trade_date."""
    aspects = list(lexicon)
    bars = PR.clean_prices(bars)
    ps = paragraph_scores(texts, vectors, lexicon, dim)
    comp = F.col("sentiment_compound")
    # one pass over paragraphs: day sentiment, per-aspect sentiment (mean over
    # the paragraphs carrying the aspect) and the pooled vector
    extra = [F.avg(comp).alias("sentiment_score")] + [
        F.avg(F.when(F.map_contains_key("aspect_scores", F.lit(a)), comp)).alias(f"_s_{a}") for a in aspects]
    fd = NV.firm_day_embedding(ps, text_col="paragraph", dim=dim, extra_aggs=extra)
    nov = NV.novelty(fd)
    cols = {}
    for a in aspects:
        sent = F.coalesce(F.col(f"_s_{a}"), F.lit(0.0))
        cols[f"{a}_sentiment"] = sent
        cols[f"{a}_shock"] = sent * F.col("novelty_score")
    panel = nov.withColumns(cols).select("ticker", "date", "sentiment_score", "novelty_score", *cols)
    fac = bar_factors(bars).withColumnRenamed("return_1d", "forward_return")
    return attach_next_bar(panel, fac, ["forward_return", "momentum_20d", "volume_ratio", "market_return"])
