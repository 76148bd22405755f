"""Embedding pooling and novelty queries (embeddings table and filing text)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.operators import filings as FI
from tidemark.operators import novelty as NV
from tidemark.plans import inputs as I
from tidemark.plans import sqlparts as P
from tidemark.plans.registry import query, rounded

DIM = 64
CREATED_AT = datetime(2024, 3, 1)

# --------------------------------------------------------------- SQL pieces

# firm-vector rows exploded to (ticker, date, text, dim, v)
FV_LONG = f"""WITH {P.FIRM_VECTORS},
fv_long AS (SELECT ticker, date, text, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
                   unnest(embedding) AS v FROM firm_vectors)"""

# paragraphs of the derived filings, encoded: (doc_id, ticker, date, text, dim, v)
PARA_LONG = f"""WITH {P.FILINGS},
parts AS (SELECT doc_id, ticker, date,
                 unnest(regexp_split_to_array(text, '\\n[ \\t\\r\\f\\x{{0B}}]*\\n\\s*')) AS p FROM filings),
paras AS (SELECT doc_id, ticker, date, {P.collapse('p')} AS text FROM parts),
paras_nb AS (SELECT * FROM paras WHERE length(text) > 0),
enc AS (SELECT doc_id, ticker, date, text, {P.buckets('text')} AS b FROM paras_nb),
fv_long AS (SELECT doc_id, ticker, date, text, CAST(i AS INTEGER) AS dim,
                   CAST(len(list_filter(b, lambda x: x = i)) AS DOUBLE) AS v
            FROM enc, range({DIM}) t(i))"""


def novelty_sql(fd: str, days: str) -> str:
    """Novelty from firm-day vectors ``fd``(ticker, date, dim, v) (NULL-free,
    stored days only) and all firm-days ``days``(ticker, date)."""
    return f"""hist AS (
  SELECT d.ticker, d.date, h.dim, sum(h.v) AS hs
  FROM {days} d JOIN {fd} h ON h.ticker = d.ticker AND h.date >= d.date - 30 AND h.date < d.date
  GROUP BY d.ticker, d.date, h.dim),
hn AS (
  SELECT d.ticker, d.date, count(DISTINCT h.date) AS n
  FROM {days} d LEFT JOIN (SELECT DISTINCT ticker, date FROM {fd}) h
    ON h.ticker = d.ticker AND h.date >= d.date - 30 AND h.date < d.date
  GROUP BY d.ticker, d.date),
cs AS (
  SELECT c.ticker, c.date, sum(c.v * h.hs) AS dp, sum(c.v * c.v) AS na, sum(h.hs * h.hs) AS nb
  FROM {fd} c JOIN hist h ON h.ticker = c.ticker AND h.date = c.date AND h.dim = c.dim
  GROUP BY c.ticker, c.date),
nov AS (
  SELECT d.ticker, d.date, CAST(hn.n AS INTEGER) AS window_size,
         CASE WHEN NOT EXISTS (SELECT 1 FROM {fd} x WHERE x.ticker = d.ticker AND x.date = d.date) THEN 0.0
              WHEN hn.n < 5 THEN 0.5
              ELSE 1.0 - greatest(0.0, coalesce(CASE WHEN sqrt(cs.na) * sqrt(cs.nb) = 0 THEN NULL
                                                     ELSE cs.dp / (sqrt(cs.na) * sqrt(cs.nb)) END, 0.0)) END
           AS novelty_score
  FROM {days} d JOIN hn USING (ticker, date) LEFT JOIN cs USING (ticker, date))"""


FD_MEAN = f"""{FV_LONG},
fd AS (SELECT ticker, date, dim, avg(v) AS v FROM fv_long GROUP BY ticker, date, dim),
days AS (SELECT DISTINCT ticker, date FROM firm_vectors),
{novelty_sql('fd', 'days')}"""


def _fd_spark(spark, d, how="mean"):
    fv = I.firm_vectors(spark, d)
    return NV.firm_day_embedding(fv, how=how, dim=DIM)


def _long(df, vec="embedding", keys=("ticker", "date")):
    return df.select(*keys, *[c for c in df.columns if c not in (*keys, vec)],
                     F.posexplode(vec).alias("dim", "value"))


def _embed_sql(how):
    agg = {"mean": "avg(v)", "weighted_mean": "sum(length(text) * v) / sum(length(text))",
           "max_pool": "max(v)"}[how]
    return f"""{FV_LONG},
stats AS (SELECT ticker, date, CAST(sum(length(text)) AS INTEGER) AS text_length,
                 CAST(count(*) AS INTEGER) AS num_paragraphs, CAST(count(*) AS INTEGER) AS n_valid
          FROM firm_vectors GROUP BY ticker, date),
agg AS (SELECT ticker, date, dim, {agg} AS value FROM fv_long GROUP BY ticker, date, dim)
SELECT ticker, date, text_length, num_paragraphs, n_valid, dim, round(value, 6) AS value
FROM agg JOIN stats USING (ticker, date)"""


def _embed_query(how):
    def run(spark, d):
        return rounded(_long(_fd_spark(spark, d, how)))
    return run


for _how, _name in (("mean", "mean"), ("weighted_mean", "weighted"), ("max_pool", "max")):
    query(f"embed_firm_day_{_name}", _embed_sql(_how))(_embed_query(_how))


@query("novelty_firm_day", f"""{FD_MEAN}
SELECT ticker, date, round(novelty_score, 6) AS novelty_score, window_size FROM nov""")
def novelty_firm_day(spark, d):
    nov = NV.novelty(_fd_spark(spark, d))
    return rounded(nov.select("ticker", "date", "novelty_score", "window_size"))


@query("novelty_stored", f"""{FD_MEAN},
mean_hist AS (SELECT ticker, date, dim, hs FROM hist)
SELECT n.ticker, n.date, round(CAST(CAST(n.novelty_score AS REAL) AS DOUBLE), 6) AS novelty_score,
       n.window_size, TIMESTAMP '{CREATED_AT}' AS created_at, m.dim,
       round(CAST(CAST(m.hs / n.window_size AS REAL) AS DOUBLE), 6) AS value
FROM nov n JOIN mean_hist m USING (ticker, date) WHERE n.window_size >= 5""")
def novelty_stored(spark, d):
    st = NV.stored_novelty(NV.novelty(_fd_spark(spark, d)), CREATED_AT)
    return rounded(_long(st, "rolling_mean_embedding"))


@query("novelty_text_firm_day", f"""{PARA_LONG},
fd AS (SELECT ticker, date, dim, avg(v) AS v FROM fv_long GROUP BY ticker, date, dim),
days AS (SELECT DISTINCT ticker, date FROM filings),
{novelty_sql('fd', 'days')}
SELECT ticker, date, round(novelty_score, 6) AS novelty_score, window_size FROM nov""")
def novelty_text_firm_day(spark, d):
    """Filing paragraphs → hashed-word vectors → firm-day mean → novelty."""
    paras = FI.split_paragraphs(I.filings(spark, d), "text", id_cols=("doc_id", "ticker", "date"))
    enc = NV.encode(paras, "paragraph", dim=DIM)
    fd = NV.firm_day_embedding(enc, text_col="paragraph", dim=DIM)
    return rounded(NV.novelty(fd).select("ticker", "date", "novelty_score", "window_size"))


@query("novelty_rows", f"""{PARA_LONG},
rows AS (SELECT DISTINCT doc_id, ticker, date, text FROM fv_long),
day_sum AS (SELECT ticker, date, dim, sum(v) AS s FROM fv_long GROUP BY ticker, date, dim),
day_cnt AS (SELECT ticker, date, count(*) AS c FROM paras_nb GROUP BY ticker, date),
keys AS (SELECT DISTINCT ticker, date FROM paras_nb),
hist AS (SELECT k.ticker, k.date, h.dim, sum(h.s) AS hs FROM keys k JOIN day_sum h
         ON h.ticker = k.ticker AND h.date >= k.date - 30 AND h.date < k.date GROUP BY k.ticker, k.date, h.dim),
hn AS (SELECT k.ticker, k.date, coalesce(sum(h.c), 0) AS n FROM keys k LEFT JOIN day_cnt h
       ON h.ticker = k.ticker AND h.date >= k.date - 30 AND h.date < k.date GROUP BY k.ticker, k.date),
cs AS (SELECT r.doc_id, r.text, sum(r.v * h.hs) AS dp, sum(r.v * r.v) AS na, sum(h.hs * h.hs) AS nb
       FROM fv_long r JOIN hist h ON h.ticker = r.ticker AND h.date = r.date AND h.dim = r.dim
       GROUP BY r.doc_id, r.text)
SELECT r.doc_id, r.ticker, r.date, length(r.text) AS n_chars,
       round(CASE WHEN hn.n < 5 THEN 0.5
                  ELSE 1.0 - greatest(0.0, coalesce(CASE WHEN sqrt(cs.na) * sqrt(cs.nb) = 0 THEN NULL
                                                         ELSE cs.dp / (sqrt(cs.na) * sqrt(cs.nb)) END, 0.0)) END, 6)
         AS novelty_score,
       CAST(hn.n AS INTEGER) AS window_size
FROM rows r JOIN hn USING (ticker, date) LEFT JOIN cs ON cs.doc_id = r.doc_id AND cs.text = r.text""")
def novelty_rows(spark, d):
    """Each paragraph scored on its own against the firm's earlier paragraphs."""
    paras = FI.split_paragraphs(I.filings(spark, d), "text", id_cols=("doc_id", "ticker", "date"))
    enc = NV.encode(paras, "paragraph", dim=DIM)
    out = NV.novelty_rows(enc, text_col="paragraph", dim=DIM)
    return rounded(out.select("doc_id", "ticker", "date", F.length("paragraph").alias("n_chars"),
                              "novelty_score", "window_size"))


@query("novelty_series", f"""{FD_MEAN}
SELECT ticker, date, round(novelty_score, 6) AS novelty_score,
       round(CASE WHEN count(novelty_score) OVER w = 5 THEN avg(novelty_score) OVER w END, 6) AS novelty_score_rolling
FROM nov WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def novelty_series(spark, d):
    return rounded(NV.novelty_time_series(NV.novelty(_fd_spark(spark, d)), window=5))


@query("novelty_cross_section", f"""{FD_MEAN}
SELECT ticker, date, round(novelty_score, 6) AS novelty_score,
       round(CASE WHEN novelty_score IS NULL THEN NULL ELSE
         ((rank() OVER (PARTITION BY date ORDER BY novelty_score ASC NULLS LAST))
          + (count(*) OVER (PARTITION BY date, novelty_score) - 1) / 2.0)
         / count(novelty_score) OVER (PARTITION BY date) * 100.0 END, 6) AS novelty_percentile
FROM nov""")
def novelty_cross_section(spark, d):
    nov = NV.novelty(_fd_spark(spark, d)).select("ticker", "date", "novelty_score")
    return rounded(NV.cross_sectional_novelty(nov))


@query("novelty_cross_stats", f"""{FD_MEAN}
SELECT date, round(avg(novelty_score), 6) AS mean_novelty, round(median(novelty_score), 6) AS median_novelty,
       round(stddev_samp(novelty_score), 6) AS std_novelty, round(min(novelty_score), 6) AS min_novelty,
       round(max(novelty_score), 6) AS max_novelty, count(*) AS count
FROM nov GROUP BY date""")
def novelty_cross_stats(spark, d):
    return rounded(NV.cross_section_stats(NV.novelty(_fd_spark(spark, d))))


STATS_FROM, STATS_TO = date(2024, 1, 10), date(2024, 2, 20)


@query("novelty_stats", f"""{FD_MEAN},
st AS (SELECT ticker, date, CAST(novelty_score AS REAL) AS s FROM nov
       WHERE window_size >= 5 AND date >= DATE '{STATS_FROM}' AND date <= DATE '{STATS_TO}')
SELECT count(*) AS count, round(avg(s), 6) AS mean_novelty, round(stddev_samp(s), 6) AS std_novelty,
       round(min(s), 6) AS min_novelty, round(max(s), 6) AS max_novelty,
       count(DISTINCT ticker) AS unique_tickers, min(date) AS start_date, max(date) AS end_date
FROM st""")
def novelty_stats(spark, d):
    st = NV.stored_novelty(NV.novelty(_fd_spark(spark, d)), CREATED_AT)
    return rounded(NV.novelty_statistics(NV.novelty_where(st, start=STATS_FROM, end=STATS_TO)))


@query("novelty_attach_rows", f"""{FD_MEAN}
SELECT f.vec_id, f.ticker, f.date, round(n.novelty_score, 6) AS novelty_score
FROM firm_vectors f LEFT JOIN nov n USING (ticker, date)""")
def novelty_attach_rows(spark, d):
    """Firm-day novelty copied to every underlying row."""
    nov = NV.novelty(_fd_spark(spark, d))
    rows = I.firm_vectors(spark, d).select("vec_id", "ticker", "date")
    return rounded(NV.attach_group_scores(rows, nov))
