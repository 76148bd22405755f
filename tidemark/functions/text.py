"""Column-level text helpers (all JVM expressions, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.isspace() sees it, spelled so that Java regex and
# RE2 (the oracle) accept the same class.
WS_CLASS = (r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Every whitespace run that is not one plain space already (Java only).  The range in front turns
# letters away by two comparisons; whether the run began with a space is asked after that.
_WS = rf"[[\x00- \x{{85}}-\x{{3000}}]&&{WS_CLASS}]"
WS_RUN = f"{_WS}(?:(?<= ){_WS}++|(?<! ){_WS}*+)"
# A word character: letter, digit or underscore (Unicode aware).
NON_WORD = r"[^\p{L}\p{N}_]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c) -> Column:
    """Collapse every whitespace run to one space and strip both ends."""
    return F.trim(F.regexp_replace(_c(c), WS_RUN, " "))


def fill_text(c) -> Column:
    """NULL → '' and anything else cast to string."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def is_blank(c) -> Column:
    """True for NULL or whitespace-only text."""
    col = _c(c)
    return col.isNull() | col.rlike("^" + WS_CLASS + "*$")


def zero_fill(c, width: int = 10) -> Column:
    """str.zfill: left-pad with zeros, never truncate (lpad would)."""
    col = _c(c).cast("string")
    return F.when(F.length(col) >= width, col).otherwise(F.lpad(col, width, "0"))


def concat_text(a, b) -> Column:
    """``f"{a} {b}"`` with NULL read as '' (concat_ws would drop the separator)."""
    return F.concat(fill_text(a), F.lit(" "), fill_text(b))


def word_tokens(c, lower: bool = True) -> Column:
    """Whole words (letters, digits, underscore) as an array; empty pieces removed."""
    col = _c(c)
    if lower:
        col = F.lower(col)
    return F.filter(F.split(col, NON_WORD), lambda t: F.length(t) > 0)


def has_substring(text: Column, word: str) -> Column:
    """``instr(text, word) > 0``, asked only where ``contains`` finds the word: ``instr`` counts
    characters and compares at each of them, ``contains`` looks for the word's first byte, which
    leaves a word that is absent (the usual case) at a fraction of the cost."""
    return F.contains(text, F.lit(word)) & (F.instr(text, F.lit(word)) > 0)


def count_contained(text_lower: Column, words: list[str]) -> Column:
    """How many of ``words`` occur in the text as substrings."""
    if not words:
        return F.lit(0)
    # unrolled (one instr per word) so it stays inside whole-stage codegen;
    # a lambda over an array literal would run interpreted
    total = F.lit(0)
    for w in words:
        total = total + F.when(has_substring(text_lower, w), 1).otherwise(0)
    return total
