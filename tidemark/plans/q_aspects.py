"""Aspect queries on filing paragraphs (keyword, semantic, wide, aggregates,
shocks, lexicon expansion)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.fixed import DEFAULT_LEXICON
from tidemark.functions.text import NON_WORD
from tidemark.operators import aspects as A
from tidemark.operators import filings as FI
from tidemark.operators import novelty as NV
from tidemark.operators import sentiment as S
from tidemark.plans import inputs as I
from tidemark.plans import sqlparts as P
from tidemark.plans.q_novelty import novelty_sql
from tidemark.plans.registry import query, rounded

DIM = 64
ASPECTS = list(DEFAULT_LEXICON)

# ------------------------------------------------------------------ SQL side


def _term_sql(low: str, term: str) -> str:
    import re
    if "*" not in term:
        return f"strpos({low}, {P.q(term.lower())}) > 0"
    stem = term.rstrip("*")
    if "*" not in stem and re.fullmatch(r"[A-Za-z0-9 _\-]*", stem):
        return f"strpos({low}, {P.q(stem)}) > 0"
    return f"regexp_matches({low}, {P.q(term.replace('*', '.*'))})"


def kw_structs(low: str) -> str:
    items = []
    for a, terms in DEFAULT_LEXICON.items():
        cond = " OR ".join(_term_sql(low, t) for t in terms)
        items.append(f"{{'aspect': {P.q(a)}, 'kw': ({cond})}}")
    return "[" + ", ".join(items) + "]"


LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(
    f"({P.q(a)}, {P.q(t)})" for a, ts in DEFAULT_LEXICON.items() for t in ts) + ") t(aspect, term))"

ENC = f"list_transform(range({DIM}), lambda i: CAST(len(list_filter(b, lambda x: x = i)) AS DOUBLE))"


def cos_sql(a: str, b: str) -> str:
    na = f"sqrt(list_inner_product({a}, {a}))"
    nb = f"sqrt(list_inner_product({b}, {b}))"
    return f"(CASE WHEN {na} * {nb} = 0 THEN 0.0 ELSE list_inner_product({a}, {b}) / ({na} * {nb}) END)"


PARAS = f"""{P.FILINGS},
parts AS (SELECT doc_id, ticker, date, unnest(arr) AS p, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS paragraph_id
          FROM (SELECT *, regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r\\f\\x{{0B}}]*\\n\\s*') AS arr FROM filings)),
paras AS (SELECT doc_id, ticker, date, paragraph_id, {P.collapse('p')} AS paragraph FROM parts
          WHERE length({P.collapse('p')}) > 0)"""

ASPECT_VECS = f"""{LEX},
lexc AS (SELECT aspect, term, trim(replace(term, '*', '')) AS clean FROM lex
         WHERE length(trim(replace(term, '*', ''))) > 2),
lexv AS (SELECT aspect, term, {ENC} AS vec FROM (SELECT *, {P.buckets('clean')} AS b FROM lexc)),
avec AS (SELECT aspect, list(v ORDER BY dim) AS avec FROM (
           SELECT aspect, i AS dim, avg(vec[i + 1]) AS v FROM lexv, range({DIM}) t(i) GROUP BY aspect, i)
         GROUP BY aspect)"""



def scores_sql(more: str = "") -> str:
    """Every paragraph with its scores for every aspect, as CTE ``sc``; ``more``: further columns of it."""
    return f"""WITH {PARAS},
{ASPECT_VECS},
pv AS (SELECT doc_id, ticker, date, paragraph_id, paragraph, {ENC} AS vec
       FROM (SELECT *, {P.buckets('paragraph')} AS b FROM paras)),
kw AS (SELECT doc_id, paragraph_id, s.aspect AS aspect, s.kw AS kw FROM (
         SELECT doc_id, paragraph_id, unnest({kw_structs('lower(paragraph)')}) AS s FROM paras)),
sem AS (SELECT pv.doc_id, pv.paragraph_id, avec.aspect, {cos_sql('pv.vec', 'avec.avec')} AS cos
        FROM pv, avec),
sc AS (SELECT p.doc_id, p.ticker, p.date, p.paragraph_id, length(p.paragraph) AS n_chars, kw.aspect,
              kw.kw, sem.cos,
              CASE WHEN kw.kw AND sem.cos >= 0.4 THEN greatest(1.0, sem.cos)
                   WHEN kw.kw THEN CAST(1.0 AS DOUBLE) WHEN sem.cos >= 0.4 THEN sem.cos END AS score_both,
              CASE WHEN kw.kw THEN CAST(1.0 AS DOUBLE) END AS score_kw,
              CASE WHEN sem.cos >= 0.4 THEN sem.cos END AS score_sem{more}
       FROM paras p JOIN kw USING (doc_id, paragraph_id)
       JOIN sem ON sem.doc_id = kw.doc_id AND sem.paragraph_id = kw.paragraph_id AND sem.aspect = kw.aspect)"""


SCORES = scores_sql()

# ------------------------------------------------------------------ Spark side


def _paragraphs(spark, d):
    return FI.split_paragraphs(I.filings(spark, d), "text", id_cols=("doc_id", "ticker", "date"))


_VEC_CACHE: dict = {}


def _vectors(spark):
    """Aspect vectors of the default lexicon (a parameter-sized table, computed
    once per session)."""
    key = id(spark)
    if key not in _VEC_CACHE:
        _VEC_CACHE[key] = A.collect_vectors(A.aspect_vectors(spark, DEFAULT_LEXICON, dim=DIM))
    return _VEC_CACHE[key]


def _scored(spark, d, use_keyword=True, use_semantic=True):
    paras = _paragraphs(spark, d)
    if not use_semantic:   # keyword matching needs no vectors
        return A.detect_aspects(paras, "paragraph", DEFAULT_LEXICON, None, None, use_keyword, False)
    enc = NV.encode(paras, "paragraph", dim=DIM)
    return A.detect_aspects(enc, "paragraph", DEFAULT_LEXICON, _vectors(spark), "embedding",
                            use_keyword, use_semantic)


def _long(df):
    return df.select("doc_id", "paragraph_id", F.explode("aspect_scores").alias("aspect", "score"))


@query("aspect_keyword", f"""{SCORES}
SELECT doc_id, paragraph_id, aspect, round(score_kw, 6) AS score FROM sc WHERE score_kw IS NOT NULL""")
def aspect_keyword(spark, d):
    return rounded(_long(_scored(spark, d, use_semantic=False)))


@query("aspect_semantic", f"""{SCORES}
SELECT doc_id, paragraph_id, aspect, round(score_sem, 6) AS score FROM sc WHERE score_sem IS NOT NULL""")
def aspect_semantic(spark, d):
    return rounded(_long(_scored(spark, d, use_keyword=False)))


@query("aspect_scores", f"""{SCORES}
SELECT doc_id, paragraph_id, aspect, round(score_both, 6) AS score FROM sc WHERE score_both IS NOT NULL""")
def aspect_scores(spark, d):
    return rounded(_long(_scored(spark, d)))


_WIDE_COLS = ",\n       ".join(
    f"round(coalesce(max(CASE WHEN aspect = {P.q(a)} THEN score_both END), 0.0), 6) AS aspect_{a},\n       "
    f"CAST(coalesce(max(CASE WHEN aspect = {P.q(a)} THEN score_both END), 0.0) > 0 AS INTEGER) AS aspect_{a}_binary"
    for a in ASPECTS)


@query("aspect_wide", f"""{SCORES}
SELECT doc_id, paragraph_id,
       {_WIDE_COLS}
FROM sc GROUP BY doc_id, paragraph_id""")
def aspect_wide(spark, d):
    out = A.aspect_columns(_scored(spark, d), "aspect_scores", ASPECTS)
    return rounded(out.drop("ticker", "date", "paragraph", "embedding", "aspect_scores"))


@query("aspect_matched_terms", f"""WITH {PARAS},
{LEX}
SELECT p.doc_id, p.paragraph_id, l.aspect, l.term FROM paras p, lex l
WHERE CASE WHEN strpos(l.term, '*') = 0 THEN strpos(lower(p.paragraph), lower(l.term)) > 0
           ELSE strpos(lower(p.paragraph), rtrim(l.term, '*')) > 0 END""")
def aspect_matched_terms(spark, d):
    p = _paragraphs(spark, d)
    m = p.withColumn("_low", F.lower("paragraph")).select(
        "doc_id", "paragraph_id", F.explode(A.matched_terms(F.col("_low"), DEFAULT_LEXICON, lowered=True))
        .alias("aspect", "terms"))
    return m.select("doc_id", "paragraph_id", "aspect", F.explode("terms").alias("term"))


def _firm_day_sql(how):
    agg = {"mean": "avg(score_both)",
           "weighted_mean": "CASE WHEN sum(n_chars) > 0 THEN sum(score_both * n_chars) / sum(n_chars) "
                            "ELSE avg(score_both) END",
           "max": "max(score_both)"}[how]
    return f"""{SCORES}
SELECT ticker, date, aspect, round({agg}, 6) AS score FROM sc WHERE score_both IS NOT NULL
GROUP BY ticker, date, aspect"""


def _firm_day_query(how):
    def run(spark, d):
        sc = _scored(spark, d).withColumn("n_chars", F.length("paragraph"))
        return rounded(A.aggregate_aspects(sc, ["ticker", "date"], "aspect_scores", how,
                                           "n_chars" if how == "weighted_mean" else None))
    return run


for _how, _name in (("mean", "mean"), ("weighted_mean", "weighted"), ("max", "max")):
    query(f"aspect_firm_day_{_name}", _firm_day_sql(_how))(_firm_day_query(_how))


@query("aspect_map", f"""{scores_sql(', p.paragraph AS text')}
SELECT doc_id, paragraph_id, ticker, date, aspect, n_chars, text FROM sc WHERE score_both IS NOT NULL""")
def aspect_map(spark, d):
    """Long (document, paragraph, aspect) table for every detected aspect, with the paragraph's text."""
    sc = _scored(spark, d)
    return sc.select("doc_id", "paragraph_id", "ticker", "date",
                     F.explode(F.map_keys("aspect_scores")).alias("aspect"),
                     F.length("paragraph").alias("n_chars"), F.col("paragraph").alias("text"))


def _sent_sql_expr(text):
    return P.sentiment_exprs(text)["compound"]


@query("aspect_shock", f"""{SCORES},
ps AS (SELECT doc_id, paragraph_id, {_sent_sql_expr('paragraph')} AS compound FROM paras),
asent AS (SELECT sc.ticker, sc.date, sc.aspect, avg(ps.compound) AS aspect_sentiment
          FROM sc JOIN ps USING (doc_id, paragraph_id) WHERE sc.score_both IS NOT NULL
          GROUP BY sc.ticker, sc.date, sc.aspect),
fd AS (SELECT ticker, date, i AS dim, avg(CAST(len(list_filter(b, lambda x: x = i)) AS DOUBLE)) AS v
       FROM (SELECT *, {P.buckets('paragraph')} AS b FROM paras), range({DIM}) t(i)
       GROUP BY ticker, date, i),
days AS (SELECT DISTINCT ticker, date FROM filings),
{novelty_sql('fd', 'days')}
SELECT a.ticker, a.date, 'shock_' || a.aspect AS shock_name, round(a.aspect_sentiment, 6) AS aspect_sentiment,
       round(n.novelty_score, 6) AS novelty_score, round(a.aspect_sentiment * n.novelty_score, 6) AS shock
FROM asent a JOIN nov n USING (ticker, date)""")
def aspect_shock(spark, d):
    """Per firm-day and detected aspect: aspect sentiment (mean compound of the
    paragraphs carrying it) x firm-day novelty."""
    # paragraphs are whitespace-collapsed already: their lower-cased copy is
    # what the keyword scorer reads (no second whitespace pass)
    sc = S.score_sentiment(_scored(spark, d).withColumn("_low", F.lower("paragraph")), "paragraph",
                           normalized_col="_low").drop("_low")
    # per-aspect sentiment rides in the firm-day vector aggregate (one pass
    # over the paragraphs; the aspect list is the lexicon's, parameter-sized)
    comp = F.col("sentiment_compound")
    extra = [F.avg(F.when(F.map_contains_key("aspect_scores", F.lit(a)), comp)).alias(f"_s_{i}")
             for i, a in enumerate(ASPECTS)]
    nov = NV.novelty(NV.firm_day_embedding(sc, text_col="paragraph", dim=DIM, extra_aggs=extra))
    sent = F.map_filter(F.map_from_arrays(F.array(*[F.lit(a) for a in ASPECTS]),
                                          F.array(*[F.col(f"_s_{i}") for i in range(len(ASPECTS))])),
                        lambda k, v: v.isNotNull())
    sent_map = nov.select("ticker", "date", "novelty_score", sent.alias("sent"))
    shocks = A.aspect_shock(sent_map.withColumn("aspects", F.map_keys("sent")), "aspects", "sent",
                            "novelty_score")
    return rounded(shocks.select("ticker", "date", "shock_name",
                                 F.col("sent")[F.col("aspect")].alias("aspect_sentiment"),
                                 "novelty_score", "shock"))


EXPAND_SQL = f"""{LEX},
lexc AS (SELECT aspect, term, trim(replace(term, '*', '')) AS clean FROM lex
         WHERE length(trim(replace(term, '*', ''))) > 2),
sv AS (SELECT aspect, term AS seed, {ENC} AS svec FROM (SELECT *, {P.buckets('clean')} AS b FROM lexc)),
vocab AS (SELECT DISTINCT t AS term FROM (SELECT unnest({P.tokens('text')}) AS t FROM documents) WHERE length(t) > 2),
vv AS (SELECT term, {ENC} AS vec FROM (SELECT term, {P.buckets('term')} AS b FROM vocab)),
cand AS (SELECT sv.aspect, vv.term, sv.seed, {cos_sql('vv.vec', 'sv.svec')} AS cos FROM vv, sv),
top AS (SELECT aspect, term, seed, cos,
               row_number() OVER (PARTITION BY aspect, seed ORDER BY cos DESC, term) AS rank
        FROM cand WHERE cos > 0.65),
seeds AS (SELECT aspect, term, 'seed' AS origin, term AS seed, CAST(NULL AS DOUBLE) AS cos,
                 CAST(NULL AS INTEGER) AS rank FROM lex),
ex AS (SELECT * FROM seeds
       UNION ALL
       SELECT aspect, term, 'expanded' AS origin, seed, cos, CAST(rank AS INTEGER) AS rank FROM top
       WHERE rank <= 20 AND NOT EXISTS (SELECT 1 FROM lex l WHERE l.aspect = top.aspect AND l.term = top.term))"""


def _expanded(spark, d):
    """Seeds + per-seed top-20 vocabulary terms (cosine > 0.65) from the
    document vocabulary (unrounded)."""
    docs = I.table(spark, d, "documents")
    vocab = (docs.select(F.explode(F.filter(F.split(F.lower("text"), NON_WORD), lambda t: F.length(t) > 2))
                         .alias("term")).distinct())
    vocab = NV.encode(vocab, "term", dim=DIM, out="vector")
    sv = A.seed_vectors(spark, DEFAULT_LEXICON, dim=DIM)
    seeds = {(r["aspect"], r["term"]): list(r["vector"]) for r in sv.collect()}   # one per term of the lexicon
    return A.expand_lexicon(vocab, DEFAULT_LEXICON, seeds)


@query("lexicon_expand", f"""WITH {EXPAND_SQL}
SELECT aspect, term, origin, seed, round(cos, 6) AS cos, rank FROM ex""")
def lexicon_expand(spark, d):
    """Seeds + per-seed top-20 vocabulary terms (cosine > 0.65) from the
    document vocabulary."""
    return rounded(_expanded(spark, d))


@query("lexicon_summary", f"""WITH {EXPAND_SQL}
SELECT aspect, count(DISTINCT term) AS n_terms, list_sort(list(DISTINCT term)) AS terms,
       bool_or(length(trim(replace(term, '*', ''))) > 2) AS has_vector
FROM ex GROUP BY aspect""")
def lexicon_summary(spark, d):
    """Per aspect of the expanded lexicon: distinct terms, sorted, has a vector."""
    return A.lexicon_summary(spark, _expanded(spark, d).select("aspect", "term"))


@query("lexicon_overlap", f"""WITH {EXPAND_SQL},
lx AS (SELECT DISTINCT aspect, lower(term) AS term FROM ex),
sizes AS (SELECT aspect, count(*) AS n FROM lx GROUP BY aspect),
shared AS (SELECT a.aspect AS aspect_a, b.aspect AS aspect_b, count(*) AS shared
           FROM lx a JOIN lx b ON a.term = b.term AND a.aspect < b.aspect GROUP BY 1, 2)
SELECT s.aspect_a, s.aspect_b, s.shared,
       round(CAST(s.shared AS DOUBLE) / least(sa.n, sb.n), 6) AS overlap
FROM shared s JOIN sizes sa ON sa.aspect = s.aspect_a JOIN sizes sb ON sb.aspect = s.aspect_b""")
def lexicon_overlap(spark, d):
    """Share of terms two aspects of the expanded lexicon have in common (the
    design asks for at most 5 %)."""
    return rounded(A.lexicon_overlap(_expanded(spark, d).select("aspect", "term")))
