"""Keyword matching for lexicons of any size: one automaton instead of one test a term.

``aspects.term_match`` compiles a test into the plan for every term, which suits a few dozen.
Here the terms are the patterns of an Aho-Corasick automaton that every Python worker builds
once; a text is read once, however many terms there are, and the plan names the lexicon only as
a parameter of a vectorised UDF.  The rules are those of ``term_match``:

* a plain term hits as a case-folded substring;
* a term whose only '*' are at its end hits as the substring before them, not case-folded;
* any other term with '*' is a regular expression in which '*' stands for '.*'.  Its longest
  literal piece is looked up by the automaton, and the expression is tried where that occurs.

A lexicon is shipped with the UDF, so its size is bounded: one beyond ``MOST_BYTES`` is matched
in parts of that size, one after the other, each a pass over the text column.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import fill_text

#: Bytes of terms and aspects that one UDF carries.
MOST_BYTES = 16_000_000

#: Hits after which a task sends the texts matched so far on; they are numbers until then.
MOST_HITS = 100_000

_PLAIN = re.compile(r"[A-Za-z0-9 _\-]*")
_HITS = "array<struct<aspect:string,term:string>>"


class TermTable:
    """Finds which (aspect, term) pairs hit a lower-cased text."""

    def __init__(self, pairs: list[tuple[str, str]]):
        import ahocorasick

        self.pairs = pairs
        self.always: list[int] = []                       # the empty term hits everything
        self.tried: list[tuple[int, re.Pattern]] = []     # expressions without a literal piece
        self.checks: dict[int, re.Pattern] = {}
        needles: dict[str, list[int]] = {}
        for i, (_, term) in enumerate(pairs):
            needle, check = self._needle(term)
            if check is not None and not needle:
                self.tried.append((i, check))
            elif not needle:
                self.always.append(i)
            else:
                needles.setdefault(needle, []).append(i)
                if check is not None:
                    self.checks[i] = check
        self.automaton = ahocorasick.Automaton()
        for needle, ids in needles.items():
            self.automaton.add_word(needle, ids)
        if needles:
            self.automaton.make_automaton()
        self.empty = not needles

    @staticmethod
    def _needle(term: str) -> tuple[str, re.Pattern | None]:
        """(literal that must occur, expression to try then)."""
        if "*" not in term:
            return term.lower(), None
        stem = term.rstrip("*")
        if "*" not in stem and _PLAIN.fullmatch(stem):
            return stem, None
        expression = re.compile(term.replace("*", "[^\\n\\r\\u0085\\u2028\\u2029]*"))
        pieces = term.split("*")
        literal = max(pieces, key=len) if all(map(_PLAIN.fullmatch, pieces)) else ""
        return literal, expression

    def hit_ids(self, text: str) -> list[int]:
        """Numbers of the pairs that hit, ascending."""
        found = set(self.always)
        if not self.empty:
            for _, ids in self.automaton.iter(text):
                found.update(i for i in ids if i not in found
                             and (i not in self.checks or self.checks[i].search(text)))
        found.update(i for i, expression in self.tried if expression.search(text))
        return sorted(found)

    def hits(self, text: str) -> list[tuple[str, str]]:
        return [self.pairs[i] for i in self.hit_ids(text)]


def _matcher(pairs: list[tuple[str, str]]):
    @F.arrow_udf(_HITS)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = TermTable(pairs)
        aspects, terms = (pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1))

        def hits(offsets: list[int], ids: array) -> pa.Array:
            picked = pa.array(np.frombuffer(ids, dtype=np.int32))
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                [aspects.take(picked), terms.take(picked)], ["aspect", "term"]))

        for texts in batches:
            offsets, ids = [0], array("i")
            for text in texts:
                ids.extend(table.hit_ids(text.as_py() or ""))
                offsets.append(len(ids))
                if len(ids) >= MOST_HITS:     # a batch of texts is answered in pieces of bounded size
                    yield hits(offsets, ids)
                    offsets, ids = [0], array("i")
            if len(offsets) > 1 or not len(texts):
                yield hits(offsets, ids)

    return match


def lexicon_parts(lexicon: dict[str, list[str]], most_bytes: int = MOST_BYTES) -> list[list[tuple[str, str]]]:
    """The (aspect, term) pairs, repeated ones once, in parts of at most ``most_bytes``."""
    parts: list[list[tuple[str, str]]] = [[]]
    size = 0
    for pair in dict.fromkeys((a, t) for a, terms in lexicon.items() for t in terms):
        weight = len(pair[0].encode()) + len(pair[1].encode()) + 16
        if parts[-1] and size + weight > most_bytes:
            parts.append([])
            size = 0
        parts[-1].append(pair)
        size += weight
    return parts


def term_hits(text: Column, lexicon: dict[str, list[str]], lowered: bool = False,
              most_bytes: int = MOST_BYTES) -> Column:
    """array<struct<aspect, term>> of the terms that hit a text, in the lexicon's order; null
    counts as empty text, a lexicon without terms hits nothing."""
    low = text if lowered else F.lower(fill_text(text))
    found = [_matcher(part)(low) for part in lexicon_parts(lexicon, most_bytes) if part]
    return F.concat(*found) if found else F.array().cast(_HITS)


def matched_rows(df: DataFrame, text_col: str, lexicon: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """One row per text and term that hits it: the ``keep`` columns, aspect and term."""
    return df.select(*keep, F.inline(term_hits(F.col(text_col), lexicon)))


def keyword_aspects(text: Column, lexicon: dict[str, list[str]], lowered: bool = False) -> Column:
    """map<aspect, 1.0> of the aspects with a term that hits: the keyword half of
    ``aspects.extract_aspects`` for large lexicons."""
    names = F.array_distinct(F.transform(term_hits(text, lexicon, lowered), lambda h: h["aspect"]))
    return F.map_from_arrays(names, F.transform(names, lambda _: F.lit(1.0)))


def collect_lexicon(terms: DataFrame, most_bytes: int = 8 * MOST_BYTES) -> dict[str, list[str]]:
    """A long (aspect, term) table as a lexicon, if it has at most ``most_bytes``; null terms are left out."""
    pairs = terms.where("aspect IS NOT NULL AND term IS NOT NULL").select("aspect", "term").distinct()
    size = pairs.agg(F.sum(F.octet_length("aspect") + F.octet_length("term") + 16)).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"a lexicon of {size} bytes, over the bound of {most_bytes}")
    out: dict[str, list[str]] = {}
    for r in sorted(pairs.collect()):
        out.setdefault(r["aspect"], []).append(r["term"])
    return out
