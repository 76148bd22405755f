"""Business-aspect detection, aspect scores, their aggregation and shocks.

The lexicon is a parameter (aspect -> terms).  Keyword tests compile into
Column expressions (substring semantics: "gain" also hits "against"); the
semantic test compares a text vector with one vector per aspect.  Aspect
vectors are derived from the lexicon (a Python mapping of the caller's) with the
same encoder as the texts: one row per key of that mapping, collected once and
inlined as literals — the per-text work stays narrow, with no
join at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.plan import materialize

from tidemark.functions.fixed import DEFAULT_LEXICON, SIMILARITY_THRESHOLD
from tidemark.functions.models import hashed_encoder
from tidemark.functions.text import fill_text, has_substring, is_blank
from tidemark.functions.vectors import cosine_const, cosines_const, norm_dim


def term_match(text_lower: Column, term: str, whole_word: bool = False) -> Column:
    """Plain term: case-folded substring.  Term with '*': the term (not
    lower-cased) as a regex with '*' → '.*', searched anywhere; a trailing-only
    wildcard without other regex characters reduces to a substring test.
    ``whole_word`` asks for word boundaries around the match instead."""
    if whole_word:
        inner = term.lower().replace("*", "\\w*") if "*" in term else re.escape(term.lower())
        return text_lower.rlike(rf"(?U)(?<!\w)(?:{inner})(?!\w)")
    if "*" not in term:
        return has_substring(text_lower, term.lower())
    stem = term.rstrip("*")
    if "*" not in stem and re.fullmatch(r"[A-Za-z0-9 _\-]*", stem):
        return has_substring(text_lower, stem)
    return text_lower.rlike(term.replace("*", ".*"))


def keyword_flags(text: Column, lexicon: dict = DEFAULT_LEXICON, lowered: bool = False,
                  whole_word: bool = False) -> dict[str, Column]:
    low = text if lowered else F.lower(fill_text(text))
    out = {}
    for aspect, terms in lexicon.items():
        cond = F.lit(False)
        for t in terms:
            cond = cond | term_match(low, t, whole_word)
        out[aspect] = cond
    return out


def matched_terms(text: Column, lexicon: dict = DEFAULT_LEXICON, lowered: bool = False) -> Column:
    """map<aspect, array<term>> listing which terms matched (aspects with none omitted)."""
    low = text if lowered else F.lower(fill_text(text))
    keys, vals = [], []
    for aspect, terms in lexicon.items():
        hits = F.array(*[F.when(term_match(low, t), F.lit(t)) for t in terms])
        keys.append(F.lit(aspect))
        vals.append(F.filter(hits, lambda x: x.isNotNull()))
    m = F.map_from_arrays(F.array(*keys), F.array(*vals))
    return F.map_filter(m, lambda k, v: F.size(v) > 0)


def lexicon_frame(spark: SparkSession, lexicon: dict = DEFAULT_LEXICON) -> DataFrame:
    rows = [(a, t) for a, ts in lexicon.items() for t in ts]
    return spark.createDataFrame(rows, "aspect string, term string")


def aspect_vectors(spark: SparkSession, lexicon: dict = DEFAULT_LEXICON, encoder=None,
                   dim: int = 64) -> DataFrame:
    """Mean term vector per aspect: '*' removed, terms of <= 2 characters
    ignored; aspects without a usable term get no vector."""
    enc = encoder or (lambda c: hashed_encoder(c, dim))
    terms = (lexicon_frame(spark, lexicon)
             .withColumn("clean", F.trim(F.regexp_replace("term", r"\*", "")))
             .filter(F.length("clean") > 2)
             .withColumn("v", enc(F.col("clean")).cast("array<double>")))
    return (terms.groupBy("aspect")
            .agg(F.array(*[F.avg(F.col("v")[i]) for i in range(dim)]).alias("vector"),
                 F.count(F.lit(1)).alias("n_terms")))


def collect_vectors(vectors: DataFrame) -> dict[str, list[float]]:
    """Per-aspect vector table → dict: one row for each aspect of the caller's lexicon."""
    return {r["aspect"]: [float(x) for x in r["vector"]] for r in vectors.select("aspect", "vector").collect()}


def _vec_lit(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def semantic_scores(emb: Column, vectors: dict[str, list[float]],
                    cosines: Column | None = None) -> dict[str, Column]:
    """Cosine per aspect; ``cosines`` may carry a materialised array of them."""
    if cosines is None:
        cosines = cosines_const(emb, list(vectors.values()))
    return {a: cosines[i] for i, a in enumerate(vectors)}


def extract_aspects(text: Column, lexicon: dict = DEFAULT_LEXICON, emb: Column | None = None,
                    vectors: dict[str, list[float]] | None = None, use_keyword: bool = True,
                    use_semantic: bool = True, threshold: float = SIMILARITY_THRESHOLD,
                    lowered: Column | None = None, cosines: Column | None = None) -> Column:
    """map<aspect, score>: 1.0 for a keyword hit, the cosine for a semantic hit
    (>= threshold), the larger of the two when both; blank text → empty map.
    ``lowered`` may carry a materialised lower-cased text column."""
    if not -1.0 <= threshold <= 1.0:
        raise ValueError(f"the similarity threshold is a cosine: {threshold} is outside [-1, 1]")
    if use_keyword:
        kw = keyword_flags(lowered, lexicon, lowered=True) if lowered is not None else keyword_flags(text, lexicon)
    else:
        kw = {}
    sem = semantic_scores(emb, vectors, cosines) if (use_semantic and vectors and emb is not None) else {}
    names = list(dict.fromkeys([*kw.keys(), *sem.keys()]))
    if not names:
        return F.create_map().cast("map<string,double>")
    vals = []
    for a in names:
        k = F.when(kw[a], F.lit(1.0)) if a in kw else F.lit(None).cast("double")
        s = F.when(sem[a] >= threshold, sem[a]) if a in sem else F.lit(None).cast("double")
        vals.append(F.greatest(k, s))
    m = F.map_filter(F.map_from_arrays(F.array(*[F.lit(a) for a in names]), F.array(*vals)),
                     lambda k, v: v.isNotNull())
    return F.when(is_blank(fill_text(text)), F.create_map().cast("map<string,double>")).otherwise(m)


def aspect_columns(df: DataFrame, map_col: str, aspects, prefix: str = "aspect_") -> DataFrame:
    """Wide columns: ``{prefix}{a}`` score (0 when absent) and ``{prefix}{a}_binary``."""
    cols = {}
    for a in aspects:
        s = F.coalesce(F.col(map_col)[a], F.lit(0.0))
        cols[f"{prefix}{a}"] = s
        cols[f"{prefix}{a}_binary"] = (s > 0).cast("int")
    return df.withColumns(cols)


def aggregate_aspects(df: DataFrame, keys: list[str], map_col: str = "aspect_scores",
                      how: str = "mean", weight_col: str | None = None) -> DataFrame:
    """Per group and aspect, over the texts that HAVE the aspect: mean (weights
    ignored), weighted_mean (zero total weight → plain mean) or max.  Long
    output (keys…, aspect, score)."""
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    long = df.select(*keys, w.alias("_w"), F.explode(F.col(map_col)).alias("aspect", "_s"))
    if how == "mean":
        agg = F.avg("_s")
    elif how == "weighted_mean":
        agg = F.when(F.sum("_w") > 0, F.sum(F.col("_s") * F.col("_w")) / F.sum("_w")).otherwise(F.avg("_s"))
    elif how == "max":
        agg = F.max("_s")
    else:
        raise ValueError(f"Unsupported aggregation method: {how}")
    return long.groupBy(*keys, "aspect").agg(agg.alias("score"))


def aspect_sentiment(df: DataFrame, keys: list[str], map_col: str = "aspect_scores",
                     sentiment_col: str = "sentiment_compound", weight_col: str | None = None) -> DataFrame:
    """Mean sentiment of the texts carrying each aspect (optionally weighted),
    long output (keys…, aspect, aspect_sentiment, n_texts)."""
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    long = df.select(*keys, w.alias("_w"), F.col(sentiment_col).alias("_s"),
                     F.explode(F.map_keys(F.col(map_col))).alias("aspect"))
    return (long.groupBy(*keys, "aspect")
            .agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum("_w")).alias("aspect_sentiment"),
                 F.count(F.lit(1)).alias("n_texts")))


def aspect_shock(df: DataFrame, aspects_col: str, sentiment_map_col: str, novelty_col: str) -> DataFrame:
    """For every detected aspect: (aspect sentiment, default 0) × novelty, as
    rows (…, shock_name = 'shock_<aspect>', shock)."""
    out = df.withColumn("aspect", F.explode(F.col(aspects_col)))
    sent = F.coalesce(F.col(sentiment_map_col)[F.col("aspect")], F.lit(0.0))
    return out.withColumns({"shock_name": F.concat(F.lit("shock_"), F.col("aspect")),
                            "shock": sent * F.col(novelty_col)})


def lexicon_summary(spark: SparkSession, lexicon: dict | DataFrame = DEFAULT_LEXICON,
                    vectors: DataFrame | None = None) -> DataFrame:
    """Per aspect: number of distinct terms, sorted terms, whether it has a
    vector.  ``lexicon`` is a dict or an (aspect, term) DataFrame (e.g. an
    expanded lexicon); without ``vectors`` an aspect has a vector when one of
    its terms, '*' removed, is longer than two characters (the rule that
    builds aspect vectors)."""
    lex = lexicon if isinstance(lexicon, DataFrame) else lexicon_frame(spark, lexicon)
    out = lex.groupBy("aspect").agg(
        F.count_distinct("term").alias("n_terms"),
        F.array_sort(F.collect_set("term")).alias("terms"),
        F.max(F.length(F.trim(F.regexp_replace("term", r"\*", ""))) > 2).alias("_hv"))
    if vectors is None:
        return out.withColumnRenamed("_hv", "has_vector")
    vec = vectors.select("aspect", F.lit(True).alias("has_vector"))
    return (out.drop("_hv").join(vec, "aspect", "left")
            .withColumn("has_vector", F.coalesce("has_vector", F.lit(False))))


def lexicon_overlap(lex: DataFrame) -> DataFrame:
    """Per aspect pair: shared terms / the smaller aspect's term count.

    One pass over the lexicon, no self-join: each term's set of aspects (at
    most the number of aspects) yields its (a, b) aspect cells, diagonal
    included; one count per cell gives the shared terms off the diagonal and
    each aspect's size on it, read with windows over that tiny result."""
    lex = lex.select("aspect", F.lower(F.col("term")).alias("term")).distinct()
    per_term = lex.groupBy("term").agg(F.collect_set("aspect").alias("_as"))
    cells = (per_term.select(F.explode("_as").alias("aspect_a"), "_as")
             .select("aspect_a", F.explode("_as").alias("aspect_b"))
             .groupBy("aspect_a", "aspect_b").agg(F.count(F.lit(1)).alias("shared")))
    diag = F.when(F.col("aspect_a") == F.col("aspect_b"), F.col("shared"))
    sized = (cells.withColumn("_na", F.max(diag).over(Window.partitionBy("aspect_a")))
             .withColumn("_nb", F.max(diag).over(Window.partitionBy("aspect_b"))))
    return (sized.filter(F.col("aspect_a") < F.col("aspect_b"))
            .select("aspect_a", "aspect_b", "shared",
                    (F.col("shared") / F.least(F.col("_na"), F.col("_nb"))).alias("overlap")))


def seed_vectors(spark: SparkSession, lexicon: dict = DEFAULT_LEXICON, encoder=None,
                 dim: int = 64) -> DataFrame:
    """(aspect, term, vector) for every usable seed ('*' removed, > 2 characters)."""
    enc = encoder or (lambda c: hashed_encoder(c, dim))
    return (lexicon_frame(spark, lexicon)
            .withColumn("clean", F.trim(F.regexp_replace("term", r"\*", "")))
            .filter(F.length("clean") > 2)
            .select("aspect", "term", enc(F.col("clean")).cast("array<double>").alias("vector")))


def expand_lexicon(vocab: DataFrame, lexicon: dict, seeds: dict[tuple[str, str], list[float]],
                   topn: int = 20, min_cos: float = 0.65, term_col: str = "term",
                   vec_col: str = "vector") -> DataFrame:
    """Seeds plus, for every seed, the ``topn`` vocabulary terms whose cosine
    with the seed vector exceeds ``min_cos`` (ties broken by term).

    Each vocabulary row is scored against the inlined seed vectors (a bounded
    parameter, no join); the per-seed top-n is ``row_number() <= topn``, which
    Spark limits per partition before the shuffle.  Output: aspect, term,
    origin ('seed' | 'expanded'), seed, cos, rank."""
    dim = len(next(iter(seeds.values()))) if seeds else 0
    vocab = vocab.withColumn("_vnorm", norm_dim(F.col(vec_col), dim))
    sims = F.array(*[F.struct(F.lit(a).alias("aspect"), F.lit(t).alias("seed"),
                              cosine_const(F.col(vec_col), v, F.col("_vnorm")).alias("cos"))
                     for (a, t), v in seeds.items()])
    cand = (vocab.select(F.col(term_col).alias("term"),
                         F.explode(F.filter(sims, lambda s: s["cos"] > min_cos)).alias("_s"))
            .select("term", "_s.aspect", "_s.seed", "_s.cos"))
    w = Window.partitionBy("aspect", "seed").orderBy(F.col("cos").desc(), F.col("term"))
    top = (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= topn)
           .select("aspect", "term", F.lit("expanded").alias("origin"), "seed", "cos", "rank"))
    seed_rows = lexicon_frame(vocab.sparkSession, lexicon).select(
        "aspect", "term", F.lit("seed").alias("origin"), F.col("term").alias("seed"),
        F.lit(None).cast("double").alias("cos"), F.lit(None).cast("int").alias("rank"))
    return seed_rows.unionByName(top.join(seed_rows.select("aspect", "term"), ["aspect", "term"], "left_anti"))


def detect_aspects(df: DataFrame, text_col: str, lexicon: dict = DEFAULT_LEXICON,
                   vectors: dict[str, list[float]] | None = None, emb_col: str | None = None,
                   use_keyword: bool = True, use_semantic: bool = True,
                   threshold: float = SIMILARITY_THRESHOLD, out: str = "aspect_scores",
                   lowered_col: str | None = None) -> DataFrame:
    """Append the aspect score map; the lower-cased text is materialised once
    and shared by every keyword test (or taken from ``lowered_col``)."""
    tmp = df.withColumn("_alow", F.col(lowered_col) if lowered_col else F.lower(fill_text(F.col(text_col))))
    cosines = None
    if emb_col and vectors and use_semantic:
        tmp = tmp.withColumn("_acos", cosines_const(emb_col, list(vectors.values())))
        cosines = F.col("_acos")
    m = extract_aspects(F.col(text_col), lexicon, F.col(emb_col) if emb_col else None, vectors,
                        use_keyword, use_semantic, threshold, lowered=F.col("_alow"), cosines=cosines)
    # behind a Generate barrier: a consumer's explode makes the optimizer infer
    # ``size(map) > 0`` and push it below the projections, which would compute
    # the whole map (every keyword test) twice per row
    return materialize(tmp, **{out: m}).drop("_alow", "_acos")
