"""DuckDB SQL fragments mirroring the Spark inputs and Column helpers.

The oracle is written independently in SQL; these helpers only keep the
repeated pieces (derived inputs, whitespace class, keyword counts, encoder)
in one place.
"""

from __future__ import annotations

from tidemark.functions.fixed import NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS
from tidemark.functions.text import NON_WORD, WS_CLASS
from tidemark.plans import inputs as I


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS_CLASS}+', ' ', 'g'))"


def blank(x: str) -> str:
    return f"({x} IS NULL OR regexp_matches({x}, '^{WS_CLASS}*$'))"


def fill(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def count_contained(low: str, words) -> str:
    return f"len(list_filter({lst(words)}, lambda w: strpos({low}, w) > 0))"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{NON_WORD}'), lambda t: length(t) > 0)"


def buckets(x: str, dim: int = 64) -> str:
    return f"list_transform({tokens(x)}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim})"


def encode_from_buckets(b: str, dim: int = 64) -> str:
    return f"list_transform(range({dim}), lambda i: CAST(len(list_filter({b}, lambda x: x = i)) AS DOUBLE))"


def round_list(x: str, d: int = 6) -> str:
    return f"list_transform({x}, lambda v: round(v, {d}))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


def cosine(a: str, b: str) -> str:
    return (f"coalesce(CASE WHEN sqrt({dot(a, a)}) * sqrt({dot(b, b)}) = 0 THEN NULL "
            f"ELSE {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) END, 0.0)")


# ------------------------------------------------------------ derived inputs

FILINGS = f"""filings AS (
  SELECT doc_id, upper(source) AS ticker,
         CAST(DATE '{I.FILING_EPOCH}' + CAST(floor(doc_id / {I.DOCS_PER_TICKER_DAY}) AS INTEGER) * {I.DAYS_PER_STEP} AS DATE) AS date,
         {lst(I.FILING_BANK)}[doc_id % {len(I.FILING_BANK)} + 1] || chr(10) || chr(10) || text AS text,
         lang, source
  FROM documents)"""


def _bars(src: str, ticker: str, ts: str, px: str, qty: str | None, seq: str) -> str:
    vol = "count(*)" if qty is None else f"sum({qty})"
    return f"""(
  SELECT {ticker} AS ticker, CAST({ts} AS DATE) AS date,
         arg_min({px}, {{'t': {ts}, 's': {seq}}}) AS open, max({px}) AS high, min({px}) AS low,
         arg_max({px}, {{'t': {ts}, 's': {seq}}}) AS close, CAST({vol} AS BIGINT) AS volume
  FROM {src} GROUP BY 1, 2)"""


BARS_LONG = "bars AS " + _bars(
    "lineitem", "'SRC' || CAST(l_suppkey - 1 AS VARCHAR)", "l_shipdate",
    "CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END", "l_quantity",
    "l_orderkey * 8 + l_linenumber")

BARS_SHORT = "bars AS " + _bars(
    "events", "'U' || CAST(user_id AS VARCHAR)", "ts", "value", None, "event_id")

FIRM_VECTORS = """firm_vectors AS (
  SELECT vec_id, 'F' || CAST(label AS VARCHAR) AS ticker,
         CAST(DATE '2024-01-01' + CAST(vec_id % 60 AS INTEGER) AS DATE) AS date,
         'vec ' || CAST(vec_id AS VARCHAR) AS text,
         CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings)"""

NEWS = f"""news AS (
  SELECT f.doc_id,
         CASE WHEN strpos(f.text, chr(10) || chr(10)) > 0
              THEN substr(f.text, 1, strpos(f.text, chr(10) || chr(10)) - 1) ELSE f.text END AS title,
         CASE WHEN strpos(f.text, chr(10) || chr(10)) > 0
              THEN substr(f.text, strpos(f.text, chr(10) || chr(10)) + 2) ELSE NULL END AS summary,
         'https://news.example/' || md5(d.text) AS link,
         f.source,
         TIMESTAMP '{I.NEWS_EPOCH}' + to_minutes(CAST(f.doc_id * 10 AS BIGINT)) AS published_date,
         TIMESTAMP '{I.NEWS_EPOCH}' + to_seconds(CAST(f.doc_id AS BIGINT)) AS collected_at,
         f.doc_id AS feed_pos
  FROM filings f JOIN documents d USING (doc_id))"""


def sentiment_exprs(text: str) -> dict:
    """label, positive, negative, neutral, compound of the default scorer."""
    low = f"lower({collapse(fill(text))})"
    p = f"CAST({count_contained(low, POSITIVE_KEYWORDS)} AS DOUBLE)"
    n = f"CAST({count_contained(low, NEGATIVE_KEYWORDS)} AS DOUBLE)"
    b = blank(fill(text))
    pos = f"(CASE WHEN {b} THEN 0.33 ELSE {p} / ({p} + {n} + 1.0) END)"
    neg = f"(CASE WHEN {b} THEN 0.33 ELSE {n} / ({p} + {n} + 1.0) END)"
    neu = f"(CASE WHEN {b} THEN 0.34 ELSE 1.0 / ({p} + {n} + 1.0) END)"
    label = (f"(CASE WHEN {pos} >= {neg} AND {pos} >= {neu} THEN 'positive' "
             f"WHEN {neg} >= {neu} THEN 'negative' ELSE 'neutral' END)")
    return {"label": label, "positive": pos, "negative": neg, "neutral": neu,
            "compound": f"({pos} - {neg})"}


def sentiment_cols(text: str, prefix: str = "sentiment_") -> str:
    return ", ".join(f"{v} AS {prefix}{k}" for k, v in sentiment_exprs(text).items())
