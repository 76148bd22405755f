"""Sentiment and news-polarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.fixed import NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS
from tidemark.operators import news as N
from tidemark.operators import sentiment as S
from tidemark.plans import inputs as I
from tidemark.plans import sqlparts as P
from tidemark.plans.registry import query, rounded

SCORED_SQL = f"""WITH {P.FILINGS},
scored AS (SELECT doc_id, ticker, date, length(text) AS n_chars, {P.sentiment_cols('text')} FROM filings)"""


def _scored(spark, d):
    return S.score_sentiment(I.filings(spark, d), "text")


@query("sentiment_scores", f"""{SCORED_SQL}
SELECT doc_id, ticker, date, sentiment_label, round(sentiment_positive, 6) AS sentiment_positive,
       round(sentiment_negative, 6) AS sentiment_negative, round(sentiment_neutral, 6) AS sentiment_neutral,
       round(sentiment_compound, 6) AS sentiment_compound
FROM scored""")
def sentiment_scores(spark, d):
    s = _scored(spark, d)
    return rounded(s.select("doc_id", "ticker", "date", "sentiment_label", "sentiment_positive",
                            "sentiment_negative", "sentiment_neutral", "sentiment_compound"))


@query("sentiment_scores_dedup", f"""{SCORED_SQL}
SELECT sentiment_label, count(*) AS n, round(sum(sentiment_compound), 6) AS sum_compound
FROM scored GROUP BY sentiment_label""")
def sentiment_scores_dedup(spark, d):
    """Score each distinct text once (model-scorer path), join back, summarise."""
    s = S.score_sentiment(I.filings(spark, d), "text", dedupe=True)
    return rounded(s.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n"),
                                                     F.sum("sentiment_compound").alias("sum_compound")))


def _daily(how):
    agg = {"mean": "avg(sentiment_compound)", "median": "median(sentiment_compound)",
           "sum": "coalesce(sum(sentiment_compound), 0.0)"}[how]
    return f"""{SCORED_SQL},
daily AS (SELECT date, CAST({agg} AS DOUBLE) AS v FROM scored WHERE date IS NOT NULL GROUP BY date)
SELECT date, round(v, 6) AS sentiment_compound,
       round(CASE WHEN count(v) OVER w = 5 THEN avg(v) OVER w END, 6) AS sentiment_compound_rolling
FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""


def _daily_query(how):
    def run(spark, d):
        ts = S.sentiment_time_series(_scored(spark, d), "date", "sentiment_compound", how, window=5)
        return rounded(ts)
    return run


for _how in ("mean", "median", "sum"):
    query(f"sentiment_daily_{_how}", _daily(_how))(_daily_query(_how))


@query("sentiment_firm_day", f"""{SCORED_SQL},
agg AS (
  SELECT ticker, date,
         sum(n_chars * coalesce(sentiment_positive, 0)) / sum(n_chars) AS positive,
         sum(n_chars * coalesce(sentiment_negative, 0)) / sum(n_chars) AS negative,
         sum(n_chars * coalesce(sentiment_neutral, 0)) / sum(n_chars) AS neutral,
         sum(n_chars * coalesce(sentiment_compound, 0)) / sum(n_chars) AS compound,
         count(*) AS n_texts
  FROM scored GROUP BY ticker, date)
SELECT ticker, date, round(positive, 6) AS positive, round(negative, 6) AS negative,
       round(neutral, 6) AS neutral, round(compound, 6) AS compound, n_texts,
       CASE WHEN positive >= negative AND positive >= neutral THEN 'positive'
            WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END AS label
FROM agg""")
def sentiment_firm_day(spark, d):
    s = _scored(spark, d).withColumn("n_chars", F.length("text"))
    return rounded(S.aggregate_sentiment(s, ["ticker", "date"], weight_col="n_chars"))


@query("sentiment_label_counts", f"""{SCORED_SQL}
SELECT sentiment_label, count(*) AS n, round(avg(sentiment_compound), 6) AS mean_compound
FROM scored GROUP BY sentiment_label""")
def sentiment_label_counts(spark, d):
    return rounded(S.label_counts(_scored(spark, d)))


@query("sentiment_token_windows", f"""WITH {P.FILINGS},
w AS (SELECT doc_id, string_split({P.collapse('text')}, ' ') AS words,
             CASE WHEN length({P.collapse('text')}) = 0 THEN 0 ELSE len(string_split({P.collapse('text')}, ' ')) END AS n
      FROM filings),
x AS (SELECT doc_id, words, n, unnest(range(0, CAST(ceil(n / 64.0) AS BIGINT))) AS window_id FROM w WHERE n > 0),
s AS (SELECT doc_id, window_id, array_to_string(words[window_id * 64 + 1 : window_id * 64 + 64], ' ') AS window_text,
             least(64, n - window_id * 64) AS n_tokens FROM x)
SELECT doc_id, CAST(window_id AS INTEGER) AS window_id, CAST(n_tokens AS INTEGER) AS n_tokens,
       {P.sentiment_exprs('window_text')['label']} AS sentiment_label,
       round({P.sentiment_exprs('window_text')['compound']}, 6) AS sentiment_compound
FROM s""")
def sentiment_token_windows(spark, d):
    """Whole texts cut into <= 64-token windows, each window scored."""
    w = S.token_windows(I.filings(spark, d), "text", 64, id_cols=("doc_id",))
    s = S.score_sentiment(w, "window_text")
    return rounded(s.select("doc_id", "window_id", F.col("n_tokens").cast("int").alias("n_tokens"),
                            "sentiment_label", "sentiment_compound"))


NEWS_SQL = f"WITH {P.FILINGS},\n{P.NEWS}"


@query("news_polarity", f"""{NEWS_SQL},
c AS (SELECT doc_id, source,
             CAST({P.count_contained("lower(coalesce(title, '') || ' ' || coalesce(summary, ''))", POSITIVE_KEYWORDS)} AS INTEGER) AS positive_count,
             CAST({P.count_contained("lower(coalesce(title, '') || ' ' || coalesce(summary, ''))", NEGATIVE_KEYWORDS)} AS INTEGER) AS negative_count
      FROM news)
SELECT doc_id, source, positive_count, negative_count,
       CASE WHEN positive_count > negative_count THEN 'positive'
            WHEN negative_count > positive_count THEN 'negative' ELSE 'neutral' END AS polarity
FROM c""")
def news_polarity(spark, d):
    out = N.keyword_polarity(I.news(spark, d))
    return out.select("doc_id", "source", "positive_count", "negative_count", "polarity")
