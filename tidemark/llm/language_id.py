"""Language identification with language-bitmask n-gram filters.

Fit: the character n-grams that occur in at least ``min_share`` of a language's
training documents go into a bit-sliced Bloom filter: row ``r`` of the table is a
bitmask with one bit per language, so one probe of ``hashes`` rows, ANDed,
returns every language that contains the n-gram.  Document frequencies are
counted by Spark over a bounded sample per language (``sample_per_language``,
drawn by a hash of the id); the model is at most ``grams_per_language`` n-grams
for each language.

Predict: each whole text is one pass of vectorised probes; per language the hits
are counted and corrected for the false positives that the filter's fill
predicts.  The largest corrected share of n-grams decides.  Rows are independent:
no shuffle, and a text of any length is probed in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, small_batches, texts_of

#: Bound of the training sample: documents of each language.
SAMPLE_PER_LANGUAGE = 1500
#: n-grams kept for each language: those in the most training documents.
GRAMS_PER_LANGUAGE = 8000
MIN_SHARE = 0.01
ORDERS = (3, 4)
HASHES = 3
ROWS_PER_GRAM = 16
#: Characters probed at once.
BLOCK_CHARS = 500_000
UNDETERMINED = "und"

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93],
                        dtype=np.uint64)
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter; built once per worker."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def normalise(text: str) -> np.ndarray:
    """Lower-cased code points with every run of other characters as one space, a
    space at both ends; empty if there is no letter."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint32)
    codes = np.where(letter, codes, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    return codes[keep]


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the n-grams of ``codes``."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    h = np.full(n, order, np.uint64)
    for i in range(order):
        h = (h ^ wide[i:i + n]) * _MULTIPLIERS[i]
        h ^= h >> np.uint64(31)
    return h


def _positions(h: np.ndarray, i: int, mask: int) -> np.ndarray:
    """Table row of the i-th probe (double hashing)."""
    with np.errstate(over="ignore"):
        step = (h >> np.uint64(32)) | np.uint64(1)
        return ((h + step * np.uint64(i)) * _MULTIPLIERS[1] >> np.uint64(20)) & np.uint64(mask)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray              # (rows, words of 64 languages)
    false_rate: np.ndarray         # per language

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> LanguageModel:
        languages = sorted(grams)
        total = sum(len(g) for g in grams.values())
        rows = 1 << max(10, (total * ROWS_PER_GRAM - 1).bit_length())
        table = np.zeros((rows, max(1, -(-len(languages) // 64))), np.uint64)
        for no, lang in enumerate(languages):
            bit = np.uint64(1) << np.uint64(no % 64)
            for i in range(HASHES):
                at = _positions(grams[lang], i, rows - 1)
                table[at, no // 64] |= bit
        fill = np.array([((table[:, no // 64] >> np.uint64(no % 64)) & np.uint64(1)).mean()
                         for no in range(len(languages))])
        return cls(languages, table, fill ** HASHES)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Per language: how many of the n-grams its filter contains."""
        mask = self.table.shape[0] - 1
        found = self.table[_positions(h, 0, mask)]
        for i in range(1, HASHES):
            found &= self.table[_positions(h, i, mask)]
        return np.array([int(((found[:, no // 64] >> np.uint64(no % 64)) & np.uint64(1)).sum())
                         for no in range(len(self.languages))], np.int64)

    def predict(self, text: str) -> tuple[str, float, float]:
        """(language, score, evidence).  Evidence is the corrected share of n-grams
        that the language's filter contains, score its part of all languages'
        evidence.  No letter or no learned language: ("und", 0, 0).  Ties go to the
        language first by name; with no evidence at all the score is 1 / languages."""
        codes = normalise(text)
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0, 0.0
        n, hits = 0, np.zeros(len(self.languages), np.int64)
        with np.errstate(over="ignore"):
            for at in range(0, len(codes), BLOCK_CHARS):
                for order in ORDERS:       # blocks overlap so that no n-gram is lost or met twice
                    h = gram_hashes(codes[at:at + BLOCK_CHARS + order - 1], order)
                    n += len(h)
                    hits += self.hits(h)
        rate = np.clip((hits / max(n, 1) - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
        best = int(np.argmax(rate))
        total = float(rate.sum())
        return self.languages[best], float(rate[best] / total) if total > 0 else 1 / len(rate), float(rate[best])


def fit(train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_per_language: int = SAMPLE_PER_LANGUAGE, grams_per_language: int = GRAMS_PER_LANGUAGE,
        min_share: float = MIN_SHARE) -> LanguageModel:
    """Learn from rows with text and language; others are ignored.  No such row: a
    model without languages.  Only the counts per language and the kept n-grams
    (bounded by the parameters) come to the driver."""
    small_batches(train.sparkSession)
    rows = train.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel.build({})
    scale = 1 << 30
    limit = None
    for lang, n in sorted(counts.items()):
        part = F.lit(min(scale, int(scale * sample_per_language / n)))
        limit = F.when(F.col("lang") == lang, part) if limit is None else limit.when(F.col("lang") == lang, part)
    draw = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(scale))
    sample = rows.where(draw < limit)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), texts_of(part)):
                    codes = normalise(text)
                    with np.errstate(over="ignore"):
                        h = [gram_hashes(codes, order) for order in ORDERS]
                    found.setdefault(lang, []).append(np.unique(np.concatenate(h)))
                for lang, lists in found.items():
                    h, n = np.unique(np.concatenate(lists), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())],
                        names=["lang", "gram", "n"])

    counted = sample.mapInArrow(grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    kept: dict[str, list[tuple[int, int]]] = {}
    least = None
    for lang, n in sorted(counts.items()):
        part = F.lit(max(1, int(min(n, sample_per_language) * min_share)))
        least = F.when(F.col("lang") == lang, part) if least is None else least.when(F.col("lang") == lang, part)
    for r in counted.where(F.col("n") >= least).toLocalIterator():
        kept.setdefault(r["lang"], []).append((-r["n"], r["gram"]))
    return LanguageModel.build({
        lang: np.array(sorted(g for _, g in sorted(found)[:grams_per_language]), np.int64).view(np.uint64)
        for lang, found in kept.items()})


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text",
             keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus lang_pred, score and evidence for every row.

    Null, empty and letterless texts are ``und`` with score 0; repeated rows are
    predicted alike; other columns are neither read nor returned."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(text_col).alias("_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "_text"):
                got = [m.predict(t) for t in texts_of(part, "_text")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), pa.array([g[0] for g in got], pa.string()),
                     pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())],
                    names=[*keep, "lang_pred", "score", "evidence"])

    types = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keep)
    return src.mapInArrow(run, f"{types}, lang_pred string, score double, evidence double")


def held_out(key: Column) -> Column:
    """Documents kept out of training: crc32 of the id's text modulo 4 is 2."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))
