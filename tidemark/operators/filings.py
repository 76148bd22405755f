"""Filing index parsing and filing-text processing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fixed import FILING_URL_BASE, SECTION_ITEMS, SECTION_PATTERN
from tidemark.functions.text import NON_WORD, WS_CLASS, collapse_ws, is_blank, zero_fill

# ---------------------------------------------------------------- index files

INDEX_HEADER_FIELDS = ["Company Name", "Form Type", "CIK", "Date Filed", "File Name"]


def parse_index_lines(lines: DataFrame, file_col: str = "file_path", pos_col: str = "pos",
                      line_col: str = "line") -> DataFrame:
    """Fixed-width company index → rows.

    Per file the header line (naming both 'Form Type' and 'Company Name') is
    located with a per-file aggregate; lines after it and the ruler below it
    are cut at the header's column offsets, so columns are bound by header
    name.  Blank lines are dropped.  The per-file header table has one row per
    file and is joined back (AQE broadcasts it when small)."""
    is_header = F.col(line_col).contains("Form Type") & F.col(line_col).contains("Company Name")
    hdr = (lines.filter(is_header)
           .groupBy(file_col)
           .agg(F.min_by(F.struct(F.col(pos_col).alias("hpos"), F.col(line_col).alias("hline")),
                         F.col(pos_col)).alias("_h"))
           .select(file_col, "_h.hpos", "_h.hline"))
    offs = {name: F.instr(F.col("hline"), name) for name in INDEX_HEADER_FIELDS}
    body = (lines.join(hdr, file_col)
            .filter((F.col(pos_col) > F.col("hpos") + 1) & (F.trim(F.col(line_col)) != "")))

    return body.select(F.col(file_col), *_index_columns(F.col(line_col), offs))


def _index_columns(line: Column, offs: dict) -> list[Column]:
    """Cut a fixed-width index line at the header's column offsets."""
    def cut(start: Column, end: Column | None) -> Column:
        if end is None:
            return F.trim(line.substr(start, F.length(line) + 1))
        return F.trim(line.substr(start, end - start))

    return [
        cut(offs["Company Name"], offs["Form Type"]).alias("company_name"),
        cut(offs["Form Type"], offs["CIK"]).alias("form_type"),
        cut(offs["CIK"], offs["Date Filed"]).alias("cik_raw"),
        cut(offs["Date Filed"], offs["File Name"]).alias("date_raw"),
        cut(offs["File Name"], None).alias("filename"),
    ]


def parse_index_text(files: DataFrame, file_col: str = "file_path", text_col: str = "value") -> DataFrame:
    """Whole index files (one row per file, e.g. ``wholetext`` reads) → rows,
    in one pass: each file's header line is located inside its own row, so
    unlike ``parse_index_lines`` no per-file aggregate, join or shuffle is
    needed.  Same rules: columns bound by header name, the ruler below the
    header skipped, blank lines dropped, files without a header dropped."""
    lines = F.split(F.col(text_col), r"\r?\n")
    hidx = F.array_position(
        F.transform(lines, lambda l: l.contains("Form Type") & l.contains("Company Name")), True)
    per_file = files.select(F.col(file_col), lines.alias("_lines"), hidx.alias("_hidx")).filter(F.col("_hidx") > 0)
    per_file = per_file.withColumn("_hline", F.element_at("_lines", F.col("_hidx").cast("int")))
    body = (per_file.select(F.col(file_col), "_hidx", "_hline", F.posexplode("_lines").alias("_pos", "_line"))
            .filter((F.col("_pos") > F.col("_hidx")) & (F.trim(F.col("_line")) != "")))
    offs = {name: F.instr(F.col("_hline"), name) for name in INDEX_HEADER_FIELDS}
    return body.select(F.col(file_col), *_index_columns(F.col("_line"), offs))


def filter_forms(df: DataFrame, form: str = "8-K", exact: bool = False) -> DataFrame:
    """Form type containing ``form`` (amendments pass) or equal to it."""
    cond = (F.col("form_type") == form) if exact else F.col("form_type").contains(form)
    return df.filter(F.coalesce(cond, F.lit(False)))


def with_filing_keys(df: DataFrame, base_url: str = FILING_URL_BASE) -> DataFrame:
    """cik zero-filled to 10 (never truncated), date_filed parsed, accession
    cut from the file name, absolute filing URL."""
    return df.select(
        "form_type", "company_name",
        zero_fill(F.col("cik_raw"), 10).alias("cik"),
        F.coalesce(F.try_to_date(F.col("date_raw"), "yyyyMMdd"),
                   F.try_to_date(F.col("date_raw"), "yyyy-MM-dd")).alias("date_filed"),
        "filename",
        F.regexp_extract(F.col("filename"), r"([0-9-]+)\.txt$", 1).alias("accession"),
        F.concat(F.lit(base_url + "/"), F.col("filename")).alias("filing_url"),
    )


def filings_between(df: DataFrame, start: date, end: date, date_col: str = "date_filed") -> DataFrame:
    """Inclusive date range, weekdays only (Monday = 0 … Friday = 4)."""
    d = F.col(date_col)
    return df.filter(d.between(F.lit(start), F.lit(end)) & (F.weekday(d) < 5))


def filter_tickers(df: DataFrame, ticker_cik: DataFrame | None, tickers: list[str] | None = None) -> DataFrame:
    """Filings of CIKs that belong to the firms of ``ticker_cik`` (optionally
    narrowed to ``tickers``).  No mapping, or an explicitly empty list, means
    no filter.  The mapping (one row per firm) is semi-joined."""
    if ticker_cik is None or (tickers is not None and len(tickers) == 0):
        return df
    m = ticker_cik.filter(F.col("ticker").isin(tickers)) if tickers else ticker_cik
    keys = m.select(zero_fill(F.col("cik"), 10).alias("cik")).distinct()
    return df.join(keys, "cik", "left_semi")


def new_filings(index: DataFrame, stored: DataFrame) -> DataFrame:
    """Filings not stored yet (same CIK and accession)."""
    return index.join(stored.select("cik", "accession"), ["cik", "accession"], "left_anti")


# ---------------------------------------------------------------- HTML → text

# What follows a tag name: a value may be quoted (and then hold '>'); a quote anywhere else is a character.
_ATTRIBUTES = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|)[^>=]*+)*+"""

#: One alternation reads the markup from left to right, so a comment hides the tags in it and raw
#: text hides comments.  What groups 2 and 3 matched stays: the name and end of a table tag.
MARKUP = (
    r"(?is)<(?:"
    r"!--.*?-->"                                                             # comment
    r"|!\[CDATA\[.*?\]\]>"
    rf"|(script|style)(?=[\s/>]){_ATTRIBUTES}(?<!/)>.*?(?:</\s*\1\s*>|\z)"   # raw text
    r"|(?!!--)[!?/](?!table[\s>])[^>]*>"                                      # declaration, closing tag
    rf"|(?!/?table[\s/>])[a-z]{_ATTRIBUTES}>"                                # opening tag
    rf"|table(?=[\s/]){_ATTRIBUTES}(?<=/)>)"                                 # a table closed at once
    rf"|(</?table)(?=[\s/>]){_ATTRIBUTES}(>)")


#: A noncharacter, which no text may hold.
_CUT = "\ufdd0"


def drop_tables(c: Column) -> Column:
    """Remove table subtrees at any nesting: the text is cut before each table tag, a
    running depth follows opening and closing tags, and only parts at depth 0 stay.
    A table that is never closed takes the rest with it; a stray closing tag goes alone."""
    tag = r"(?i)(?=</?table[\s/>])"
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, part: Column) -> Column:
        opens, closes = part.rlike(r"(?i)^<table[\s/>]"), part.rlike(r"(?i)^</table[\s/>]")
        depth = (F.when(opens, state["depth"] + 1).when(closes, F.greatest(state["depth"] - 1, F.lit(0)))
                 .otherwise(state["depth"]))
        body = F.when(opens | closes, F.regexp_replace(part, r"^<[^>]*>?", "")).otherwise(part)
        kept = F.when(depth == 0, F.concat(state["kept"], F.array(body))).otherwise(state["kept"])
        return F.struct(depth.alias("depth"), kept.alias("kept"))

    return F.aggregate(F.split(c, tag), start, step, lambda state: F.array_join(state["kept"], ""))


# ---------------------------------------------------------------- character references

#: Buckets of the table of named references: a name is found by its crc32, not by a search.
_BUCKETS = 2048
_NUMBER = r"^&#(?:0*([0-9]+)|[xX]0*([0-9a-fA-F]+));?"


def _bucketed_names() -> Column:
    """Array of ``\\x01 name \\x02 text \\x01 name ...`` strings, by crc32 of the name; one literal."""
    from html.entities import html5
    from zlib import crc32

    buckets = [""] * _BUCKETS
    for name, text in sorted(html5.items()):
        buckets[crc32(name.encode()) % _BUCKETS] += f"\x01{name}\x02{text}"
    return F.split(F.lit("\x03".join(buckets)), "\x03")


def _named(name: Column) -> Column:
    """Text of a named reference (its semicolon included, if it has one), or null."""
    bucket = F.element_at(_bucketed_names(), (F.crc32(name.cast("binary")) % _BUCKETS + 1).cast("int"))
    at = F.instr(bucket, F.concat(F.lit("\x01"), name, F.lit("\x02")))
    return F.when(at > 0, F.substring_index(F.substr(bucket, at + F.length(name) + 2), "\x01", 1))


def _character(code: Column) -> Column:
    """Character of a numeric reference: 128 to 159 are read as windows-1252, null, surrogates
    and numbers beyond Unicode give U+FFFD, other control characters and noncharacters nothing."""
    western = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)]
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    nothing = (code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
               | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE))
    return (F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd")
            .when(code.between(128, 159), F.element_at(F.array(*[F.lit(w) for w in western]), (code - 127).cast("int")))
            .when(nothing, "").otherwise(plain))


def decode_entities(c: Column) -> Column:
    """Decode character references once (the result of one is not read again), as browsers do:
    numbers by :func:`_character`, names with their semicolon, and of a name without one the
    longest beginning that may stand without; unknown names stay as they are."""
    from html.entities import html5

    short = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))

    def number(s: Column) -> Column:
        dec, hexa = F.regexp_extract(s, _NUMBER, 1), F.regexp_extract(s, _NUMBER, 2)
        code = (F.when(F.length(dec) > 7, 0x110000).when(F.length(hexa) > 6, 0x110000)
                .when(dec != "", dec.try_cast("int")).when(hexa != "", F.conv(hexa, 16, 10).try_cast("int")))
        return F.when(code.isNull(), s).otherwise(F.concat(_character(code), F.regexp_replace(s, _NUMBER, "")))

    def name(s: Column) -> Column:
        whole = F.regexp_extract(s, r"^&([A-Za-z][A-Za-z0-9]*;?)", 1)
        begin = F.regexp_extract(s, f"^&({short})", 1)
        found, first = _named(whole), _named(begin)
        return F.coalesce(F.concat(found, F.substr(s, F.length(whole) + 2)),
                          F.concat(first, F.substr(s, F.length(begin) + 2)), s)

    def part(s: Column) -> Column:
        # the bare ampersand's own reference, by far the most frequent, needs no table
        return (F.when(s.startswith("&amp;"), F.concat(F.lit("&"), F.substr(s, F.lit(6))))
                .when(~s.startswith("&"), s).when(s.startswith("&#"), number(s)).otherwise(name(s)))

    # ``c`` is named once, as each further mention would compute it again
    return F.array_join(F.transform(F.split(c, "(?=&)"), part), "")


def html_to_text(c: Column) -> Column:
    """HTML → clean text in the JVM: markup, comments, script and style are removed in one pass that
    inserts no separators, tables by their depth if there are any, character references are decoded,
    whitespace is collapsed (non-breaking spaces too) and stripped.  A '<' that begins no tag, and a
    tag or comment that is never closed, are text."""
    # a mark where markup was keeps a reference before it from running on behind it
    x = F.regexp_replace(c, MARKUP, f"{_CUT}$2$3")
    return collapse_ws(F.replace(decode_entities(drop_tables(x)), F.lit(_CUT), F.lit("")))


def clean_html(df: DataFrame, col: str = "html", out: str = "text") -> DataFrame:
    """HTML column → clean text column."""
    return df.withColumn(out, html_to_text(F.col(col)))


# ---------------------------------------------------------------- sections

def section_pattern(item: str) -> str:
    """Item text up to the next 'Item <digit>' or the end (first match only)."""
    return SECTION_PATTERN.replace("{item}", item.replace(".", r"\."))


def extract_sections(text: Column, items=SECTION_ITEMS) -> Column:
    """map<item_key, content> for the items present; an absent item is absent."""
    keys, vals = [], []
    for item in items:
        pat = section_pattern(item)
        keys.append(F.lit("item_" + item.replace(".", "_")))
        vals.append(F.when(text.rlike(r"(?is)Item\s+" + item.replace(".", r"\.")),
                           F.trim(F.regexp_extract(text, pat, 1))))
    m = F.map_from_arrays(F.array(*keys), F.array(*vals))
    return F.map_filter(m, lambda k, v: v.isNotNull())


def sections_long(df: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """One row per (document, section)."""
    return df.select(*id_cols, F.explode(extract_sections(F.col(text_col))).alias("section", "content"))


# ---------------------------------------------------------------- paragraphs etc.

def split_paragraphs(df: DataFrame, text_col: str = "text", id_cols: tuple = ()) -> DataFrame:
    """Paragraphs separated by a blank line (two or more newlines, possibly
    with spaces between) → rows with paragraph_id; whitespace inside a
    paragraph is collapsed afterwards.  Empty paragraphs are dropped."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n[ \t\r\f\x{0B}]*\n" + r"\s*")
    out = df.select(*id_cols, F.posexplode(parts).alias("paragraph_id", "_p"))
    # blank test on the raw piece (cheap, stops at the first visible character)
    # instead of filtering on the collapsed text, which would run the
    # whitespace regex twice once the filter is pushed below the projection
    return (out.filter(~is_blank(F.col("_p")))
            .select(*id_cols, "paragraph_id", collapse_ws(F.col("_p")).alias("paragraph")))


def min_length(df: DataFrame, col: str = "paragraph", n: int = 50) -> DataFrame:
    return df.filter(F.length(F.col(col)) >= n)


# Stop words used to guess a text's language (small, our own lists).
STOP_WORDS = {
    "en": ["the", "and", "of", "to", "is", "in", "that", "it", "with", "for", "on", "as", "was", "this"],
    "fr": ["le", "la", "les", "des", "et", "en", "un", "une", "du", "qui", "que", "pour", "par", "au"],
    "de": ["der", "die", "das", "und", "nicht", "ist", "ein", "eine", "zu", "den", "mit", "von", "auf", "für"],
    "es": ["el", "los", "las", "y", "que", "del", "por", "con", "una", "para", "es", "se", "como", "lo"],
}


def detect_language(text: Column) -> Column:
    """Language whose stop words make up most tokens (ties: en, fr, de, es);
    'unknown' when no stop word occurs."""
    toks = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NON_WORD), lambda t: F.length(t) > 0)
    def member_of(words):
        return lambda t: t.isin(words)

    counts = {lang: F.size(F.filter(toks, member_of(ws))) for lang, ws in STOP_WORDS.items()}
    best = F.greatest(*counts.values())
    expr = F.when(best == 0, F.lit("unknown"))
    for lang, c in counts.items():
        expr = expr.when(c == best, F.lit(lang))
    return expr


def keep_language(df: DataFrame, lang: str = "en", lang_col: str | None = None,
                  text_col: str = "text") -> DataFrame:
    """Keep rows in ``lang``: from a given language column, or detected."""
    c = F.col(lang_col) if lang_col else detect_language(F.col(text_col))
    return df.filter(c == lang)


def strip_exhibits(c: Column) -> Column:
    """Lower-case, drop table subtrees and exhibit references."""
    x = F.regexp_replace(drop_tables(F.lower(c)), r"exhibit\s+[0-9]+(\.[0-9]+)?", " ")
    return collapse_ws(x)


# Personal-data patterns flagged for review.
PII_PATTERNS = {
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "ein": r"[0-9]{2}-[0-9]{7}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}
# What a match of each pattern always holds, quick to look for.
PII_SIGNS = {"ssn": r"-[0-9]{2}-", "ein": r"[0-9]-[0-9]{7}", "email": "@"}
_EDGE_L, _EDGE_R = r"(?:^|[^0-9A-Za-z_])(", r")(?:[^0-9A-Za-z_]|$)"


def pii_alerts(df: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """One row per (document, kind, matched string) for personal-data patterns.

    A pattern runs over the texts that hold what every match of it holds (``PII_SIGNS``), the
    outer ``explode`` keeps the optimizer from running all of them once more in a filter."""
    def tagged(kind):
        return lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("match"))

    text = F.col(text_col)
    arrs = [F.transform(F.when(text.rlike(PII_SIGNS[k]), F.regexp_extract_all(text, F.lit(_EDGE_L + p + _EDGE_R), 1))
                        .otherwise(F.array().cast("array<string>")), tagged(k)) for k, p in PII_PATTERNS.items()]
    return (df.select(*id_cols, F.explode_outer(F.concat(*arrs)).alias("_a")).filter(F.col("_a").isNotNull())
            .select(*id_cols, "_a.kind", "_a.match"))


def explode_ngrams(df: DataFrame, id_col: str, toks_col: str, n: int = 3, out: str = "gram") -> DataFrame:
    """One row per consecutive word n-gram of a token array.

    The array is zipped with its n-1 shifted copies (built-ins, no lambdas),
    turned into rows by ``inline_outer`` (the outer form keeps the optimizer
    from inferring a pre-filter that would build the zipped array twice), the
    padded tail is dropped and the words are joined inside whole-stage
    codegen."""
    toks = F.col(toks_col)
    names = [f"_w{k}" for k in range(n)]
    shifted = [toks] + [F.slice(toks, k + 1, F.greatest(F.size(toks) - k, F.lit(0))) for k in range(1, n)]
    rows = df.select(F.col(id_col), F.inline_outer(F.arrays_zip(*[c.alias(nm) for c, nm in zip(shifted, names)])))
    return (rows.filter(F.col(names[-1]).isNotNull())
            .select(F.col(id_col), F.concat_ws(" ", *[F.col(nm) for nm in names]).alias(out)))


def trigram_tfidf(df: DataFrame, id_col: str, text_col: str = "text", n: int = 3) -> DataFrame:
    """Word n-gram TF-IDF: tf = count in the document, idf = ln((1+N)/(1+df)) + 1.

    Grams are exploded and dealt by gram once: counts per document, document frequencies and
    their join all run on that one exchange.  N is a scalar subquery (no cross join)."""
    # splitting on a '+' class leaves empty tokens only at the ends, so a
    # built-in array_remove does what a per-token lambda filter would
    toks = df.select(F.col(id_col), F.array_remove(
        F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), NON_WORD), "").alias("_toks"))
    grams = explode_ngrams(toks, id_col, "_toks", n).repartition("gram")
    tf = grams.groupBy(id_col, "gram").agg(F.count(F.lit(1)).alias("tf"))
    dfreq = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    n_docs = df.select(F.count(F.lit(1))).scalar()
    out = tf.join(dfreq, "gram")
    idf = F.ln((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    return out.select(id_col, "gram", "tf", "df", idf.alias("idf"), (F.col("tf") * idf).alias("tfidf"))
