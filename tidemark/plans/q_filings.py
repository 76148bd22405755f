"""Filing index, filing text and news queries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.functions.fixed import FILING_URL_BASE, MAX_ARTICLES_PER_SOURCE, SECTION_ITEMS, TARGET_TICKERS
from tidemark.functions.text import collapse_ws
from tidemark.operators import filings as FI
from tidemark.operators import news as N
from tidemark.plans import inputs as I
from tidemark.plans import sqlparts as P
from tidemark.plans.registry import query, rounded

INDEX_FROM, INDEX_TO = date(1995, 1, 1), date(1998, 12, 31)
SEGMENT = "BUILDING"

FORM_SQL = """CASE WHEN starts_with(o_orderpriority, '1') THEN '8-K'
            WHEN starts_with(o_orderpriority, '2') THEN '8-K/A'
            WHEN starts_with(o_orderpriority, '3') THEN '10-K'
            WHEN starts_with(o_orderpriority, '4') THEN '10-Q' ELSE '4' END"""

INDEX_SQL = f"""idx AS (
  SELECT {FORM_SQL} AS form_type, 'Customer ' || CAST(o_custkey AS VARCHAR) AS company_name,
         lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderdate AS DATE) AS date_filed,
         'edgar/data/' || CAST(o_custkey AS VARCHAR) || '/' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-'
           || strftime(o_orderdate, '%y') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '.txt' AS filename,
         o_orderstatus
  FROM orders),
idx2 AS (SELECT *, regexp_extract(filename, '([0-9-]+)\\.txt$', 1) AS accession,
                '{FILING_URL_BASE}/' || filename AS filing_url FROM idx)"""


def _index(spark, d):
    return FI.with_filing_keys(FI.parse_index_lines(I.index_lines(spark, d)))


@query("filing_index_8k", f"""WITH {INDEX_SQL}
SELECT form_type, company_name, cik, date_filed, filename, accession, filing_url FROM idx2
WHERE strpos(form_type, '8-K') > 0 AND date_filed BETWEEN DATE '{INDEX_FROM}' AND DATE '{INDEX_TO}'
  AND isodow(date_filed) < 6
  AND cik IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') FROM customer WHERE c_mktsegment = '{SEGMENT}')""")
def filing_index_8k(spark, d):
    """Fixed-width index → 8-K rows (amendments included) of weekdays in a date
    range for the firms of one market segment."""
    idx = FI.filter_forms(_index(spark, d), "8-K")
    idx = FI.filings_between(idx, INDEX_FROM, INDEX_TO)
    mapping = I.ticker_cik(spark, d).filter(F.col("c_mktsegment") == SEGMENT)
    return FI.filter_tickers(idx, mapping)


@query("filings_new_only", f"""WITH {INDEX_SQL}
SELECT cik, accession, date_filed, form_type FROM idx2 i
WHERE NOT EXISTS (SELECT 1 FROM idx2 s WHERE s.o_orderstatus = 'F' AND s.cik = i.cik AND s.accession = i.accession)""")
def filings_new_only(spark, d):
    """Index rows not stored yet; 'stored' = filings of fulfilled orders."""
    idx = _index(spark, d)
    stored = (I.table(spark, d, "orders").filter(F.col("o_orderstatus") == "F")
              .select(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"),
                      F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-"),
                               F.date_format("o_orderdate", "yy"), F.lit("-"),
                               F.lpad(F.col("o_orderkey").cast("string"), 6, "0")).alias("accession")))
    return FI.new_filings(idx, stored).select("cik", "accession", "date_filed", "form_type")


def _html_sql(x: str) -> str:
    y = f"regexp_replace({x}, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g')"
    y = f"regexp_replace({y}, '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g')"
    y = f"regexp_replace({y}, '(?s)<!--.*?-->', '', 'g')"
    y = f"regexp_replace({y}, '(?is)<table\\b[^>]*>.*?</table\\s*>', '', 'g')"
    y = f"regexp_replace({y}, '(?s)<[^>]*>', '', 'g')"
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        y = f"regexp_replace({y}, '&{name}(;|\\b)', {P.q(ch)}, 'g')"
    return P.collapse(y)


CLEAN_PAGES_SQL = f"SELECT page_id, {_html_sql('html')} AS text FROM pages"


@query("clean_pages", CLEAN_PAGES_SQL)
def clean_pages(spark, d):
    return FI.clean_html(I.table(spark, d, "pages"), "html", "text").select("page_id", "text")


@query("clean_pages_exact", f"""SELECT page_id, trim('a b' || chr(8217) || 'c' || chr(233) || ' 1<2 &zzz; ' || text) AS text
FROM ({CLEAN_PAGES_SQL})""")
def clean_pages_exact(spark, d):
    """Pages behind nested tables and character references of every kind."""
    head = ("a<TABLE x='1'><tr><td>OUT<table><tr><td>in</td></tr></table>ER</td></tr></TABLE >&#160;<i>b</i>&#8217;c"
            "&#xE9; 1&lt;2 &zzz; ")
    pages = I.table(spark, d, "pages").withColumn("html", F.concat(F.lit(head), F.col("html")))
    return FI.clean_html(pages, "html", "text").select("page_id", "text")


@query("clean_pages_references", f"""SELECT page_id, trim('Company’s “plan” – ©foo ¬it; ab €1 ' || text) AS text
FROM ({CLEAN_PAGES_SQL})""")
def clean_pages_references(spark, d):
    """Pages behind what filings are full of: windows-1252 numbers, names without a semicolon,
    markup inside comments, quotes inside and outside of attribute values."""
    head = ("<!-- <script> -->Company&#146;s &#147;plan&#148; &#150; &copyfoo &notit; <p title=it's>a<b x='1>2'>b</b>"
            "<![CDATA[x<i>y]]> &#x80;1 ")
    pages = I.table(spark, d, "pages").withColumn("html", F.concat(F.lit(head), F.col("html")))
    return FI.clean_html(pages, "html", "text").select("page_id", "text")


def _sections_sql():
    parts = []
    for item in SECTION_ITEMS:
        esc = item.replace(".", "\\.")
        key = "item_" + item.replace(".", "_")
        parts.append(f"""SELECT doc_id, '{key}' AS section,
       trim(regexp_extract(t, '(?is)Item\\s+{esc}[^0-9]*?(.*?)(?:Item\\s+[0-9]|$)', 1)) AS content
FROM clean WHERE regexp_matches(t, '(?is)Item\\s+{esc}')""")
    return f"""WITH {P.FILINGS},
clean AS (SELECT doc_id, {P.collapse('text')} AS t FROM filings)
""" + "\nUNION ALL\n".join(parts)


@query("filing_sections", _sections_sql())
def filing_sections(spark, d):
    """Items 1.01, 1.02, 2.02, 7.01, 8.01 cut from the whitespace-cleaned text."""
    f = I.filings(spark, d).withColumn("text", collapse_ws(F.col("text")))
    return FI.sections_long(f, ["doc_id"], "text")


NOW = datetime(2024, 1, 8)
DAYS_BACK = 3


@query("news_dedupe_capped", f"""WITH {P.FILINGS},
{P.NEWS},
h AS (SELECT *, md5(coalesce(link, '')) AS url_hash FROM news),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY collected_at, feed_pos) AS rn FROM h)
          WHERE rn = 1),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY feed_pos, url_hash) AS rn2 FROM first)
           WHERE rn2 <= 50)
SELECT url_hash, doc_id, source, feed_pos, published_date FROM capped
WHERE published_date >= TIMESTAMP '{NOW}' - INTERVAL {DAYS_BACK} DAY""")
def news_dedupe_capped(spark, d):
    """First article per URL, first 50 per source in feed order, then recency."""
    n = N.with_url_hash(I.news(spark, d))
    n = N.cap_per_source(N.first_seen(n), MAX_ARTICLES_PER_SOURCE)
    n = N.recent(n, NOW, DAYS_BACK)
    return n.select("url_hash", "doc_id", "source", "feed_pos", "published_date")


@query("news_ticker_mentions", f"""WITH {P.FILINGS},
{P.NEWS},
t AS (SELECT doc_id, list_sort(list_distinct(list_filter(
         regexp_split_to_array(coalesce(title, '') || ' ' || coalesce(summary, ''), '[^\\p{{L}}\\p{{N}}_]+'),
         lambda w: list_contains({P.lst(TARGET_TICKERS)}, w)))) AS tk FROM news)
SELECT doc_id, CAST(len(tk) AS INTEGER) AS ticker_count, array_to_string(tk, ',') AS tickers FROM t""")
def news_ticker_mentions(spark, d):
    n = N.associate_tickers(I.news(spark, d))
    return n.select("doc_id", "ticker_count", F.array_join("tickers", ",").alias("tickers"))


@query("news_article_tickers", f"""WITH {P.FILINGS},
{P.NEWS},
t AS (SELECT doc_id, source, list_distinct(list_filter(
         regexp_split_to_array(coalesce(title, '') || ' ' || coalesce(summary, ''), '[^\\p{{L}}\\p{{N}}_]+'),
         lambda w: list_contains({P.lst(TARGET_TICKERS)}, w))) AS tk FROM news)
SELECT ticker, source, count(*) AS n_articles FROM (SELECT source, unnest(tk) AS ticker FROM t)
GROUP BY ticker, source""")
def news_article_tickers(spark, d):
    """Article × mentioned-ticker rows, counted per ticker and source."""
    rows = N.article_ticker_rows(N.associate_tickers(I.news(spark, d)))
    return rows.groupBy("ticker", "source").agg(F.count(F.lit(1)).alias("n_articles"))


PARA_SQL = f"""WITH {P.FILINGS},
parts AS (SELECT doc_id, unnest(arr) AS p, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS paragraph_id
          FROM (SELECT *, regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r\\f\\x{{0B}}]*\\n\\s*') AS arr FROM filings)),
paras AS (SELECT doc_id, paragraph_id, {P.collapse('p')} AS paragraph FROM parts WHERE length({P.collapse('p')}) > 0)"""


@query("paragraphs", f"""{PARA_SQL}
SELECT doc_id, paragraph_id, paragraph FROM paras""")
def paragraphs(spark, d):
    return FI.split_paragraphs(I.filings(spark, d), "text", id_cols=("doc_id",))


@query("paragraphs_min_length", f"""{PARA_SQL}
SELECT doc_id, paragraph_id, length(paragraph) AS n_chars FROM paras WHERE length(paragraph) >= 50""")
def paragraphs_min_length(spark, d):
    p = FI.min_length(FI.split_paragraphs(I.filings(spark, d), "text", id_cols=("doc_id",)), "paragraph", 50)
    return p.select("doc_id", "paragraph_id", F.length("paragraph").alias("n_chars"))


def _lang_sql(text: str) -> str:
    toks = f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 0)"
    counts = {lang: f"len(list_filter(toks, lambda t: list_contains({P.lst(ws)}, t)))"
              for lang, ws in FI.STOP_WORDS.items()}
    best = "greatest(" + ", ".join(counts.values()) + ")"
    case = f"CASE WHEN {best} = 0 THEN 'unknown' " + " ".join(
        f"WHEN {c} = {best} THEN '{lang}'" for lang, c in counts.items()) + " END"
    return toks, case


_TOKS, _LANG = _lang_sql("text")


@query("language_detect", f"""WITH d AS (SELECT doc_id, lang, {_TOKS} AS toks FROM documents)
SELECT doc_id, lang, {_LANG} AS detected FROM d""")
def language_detect(spark, d):
    docs = I.table(spark, d, "documents")
    return docs.select("doc_id", "lang", FI.detect_language(F.col("text")).alias("detected"))


@query("english_only", f"""WITH d AS (SELECT doc_id, lang, {_TOKS} AS toks FROM documents)
SELECT doc_id, lang FROM d WHERE ({_LANG}) = 'en'""")
def english_only(spark, d):
    """Documents detected as English by stop-word share (the given lang column
    is carried along for comparison)."""
    return FI.keep_language(I.table(spark, d, "documents"), "en").select("doc_id", "lang")


def _pii_sql():
    parts = []
    for kind, pat in FI.PII_PATTERNS.items():
        full = FI._EDGE_L + pat + FI._EDGE_R
        parts.append(f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all(text, {P.q(full)}, 1)) AS match "
                     f"FROM filings")
    return f"WITH {P.FILINGS}\n" + "\nUNION ALL\n".join(parts)


@query("pii_alerts", _pii_sql())
def pii_alerts(spark, d):
    return FI.pii_alerts(I.filings(spark, d), ["doc_id"], "text")


@query("strip_exhibits", f"""WITH {P.FILINGS}
SELECT doc_id, {P.collapse(f"regexp_replace(regexp_replace(lower(text), '(?s)<table\\b[^>]*>.*?</table\\s*>', ' ', 'g'), 'exhibit\\s+[0-9]+(\\.[0-9]+)?', ' ', 'g')")} AS text
FROM filings""")
def strip_exhibits(spark, d):
    f = I.filings(spark, d)
    return f.select("doc_id", FI.strip_exhibits(F.col("text")).alias("text"))


@query("tfidf_trigrams", f"""WITH toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+'),
                             lambda t: length(t) > 0) AS tk FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(tk) - 1), lambda i: array_to_string(tk[i:i + 2], ' '))) AS gram
      FROM toks WHERE len(tk) >= 3),
tf AS (SELECT doc_id, gram, count(*) AS tf FROM g GROUP BY doc_id, gram),
df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, gram, tf, df, round(ln((1.0 + n) / (1.0 + df)) + 1.0, 6) AS idf,
       round(tf * (ln((1.0 + n) / (1.0 + df)) + 1.0), 6) AS tfidf
FROM tf JOIN df USING (gram), n""")
def tfidf_trigrams(spark, d):
    return rounded(FI.trigram_tfidf(I.table(spark, d, "documents"), "doc_id", "text", 3))
