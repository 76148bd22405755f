"""Default, deterministic text models plus the plug-in points for real ones.

* ``keyword_scorer`` – three-class sentiment from polarity-keyword counts, built
  entirely from Column expressions (stays in whole-stage codegen).
* ``hashed_encoder`` – bag-of-words vector: every lower-cased word goes to bucket
  ``int(md5(word)[:8], 16) % dim``.
* ``pandas_scorer`` / ``pandas_encoder`` – wrap a caller's model into an
  iterator pandas UDF so the model is loaded once per task and fed Arrow
  batches.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fixed import NEGATIVE_KEYWORDS, NEUTRAL_SCORES, POSITIVE_KEYWORDS
from tidemark.functions.text import collapse_ws, count_contained, word_tokens

CLASS_SCORES = T.StructType([
    T.StructField("positive", T.DoubleType()),
    T.StructField("negative", T.DoubleType()),
    T.StructField("neutral", T.DoubleType()),
])


def normalize_for_keywords(text: Column) -> Column:
    """Lower-cased text with whitespace collapsed (what keyword tests read)."""
    return F.lower(collapse_ws(text))


def keyword_scorer(text: Column, positive: list[str] | None = None,
                   negative: list[str] | None = None, normalized: bool = False) -> Column:
    """struct(positive, negative, neutral) from keyword counts p, n:
    p/(p+n+1), n/(p+n+1), 1/(p+n+1).

    Pass an already normalised column (``normalized=True``) that was
    materialised with ``withColumn``: expressions captured by the keyword
    lambdas are otherwise re-evaluated per keyword."""
    low = text if normalized else normalize_for_keywords(text)
    p = count_contained(low, POSITIVE_KEYWORDS if positive is None else positive)
    n = count_contained(low, NEGATIVE_KEYWORDS if negative is None else negative)
    return class_scores(p, n)


def class_scores(p: Column, n: Column) -> Column:
    """struct(positive, negative, neutral) = (p, n, 1) / (p + n + 1) from the
    positive and negative keyword counts (pass materialised columns: each is
    referenced four times)."""
    p, n = p.cast("double"), n.cast("double")
    d = p + n + F.lit(1.0)
    return F.struct((p / d).alias("positive"), (n / d).alias("negative"),
                    (F.lit(1.0) / d).alias("neutral"))


def token_hashes(text: Column) -> Column:
    """The first eight hexadecimal digits of every word's md5."""
    return F.transform(word_tokens(text), lambda t: F.substring(F.md5(t), 1, 8))


def hash_values(digits: pa.Array) -> np.ndarray:
    """The numbers that strings of eight lower-case hexadecimal digits spell."""
    if not len(digits):
        return np.zeros(0, dtype=np.uint32)
    digits = digits.cast(pa.string())
    offsets = np.frombuffer(digits.buffers()[1], dtype=np.int32)
    start = int(offsets[digits.offset])
    code = np.frombuffer(digits.buffers()[2], dtype=np.uint8)[start:start + 8 * len(digits)]
    digit = (code & 15) + (code >> 6) * np.uint8(9)            # "0" is 0x30, "a" is 0x61
    pairs = np.left_shift(digit[0::2], 4) | digit[1::2]
    return pairs.view(">u4").astype(np.uint32)


def hashed_encoder(text: Column, dim: int = 64) -> Column:
    """array<double> of word counts per hash bucket (zero vector for no words, nulls for null).

    Each token is hashed once in the JVM; the hashes become buckets and are counted in Arrow
    batches, in one pass over a text's words instead of one a bucket."""
    @F.arrow_udf("array<double>")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches:
            n = len(part)
            sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
            cells = np.repeat(np.arange(n) * dim, sizes) + hash_values(part.flatten()) % np.uint32(dim)
            found = np.bincount(cells, minlength=n * dim).astype(float).reshape(n, dim)
            found[part.is_null().to_numpy(zero_copy_only=False)] = np.nan
            yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim),
                                           pa.array(found.reshape(-1), pa.float64(), from_pandas=True))

    return counts(token_hashes(text))


def pandas_scorer(load_model: Callable[[], Callable[[list[str]], list[dict]]]):
    """Turn a model factory into a Column -> struct(positive, negative, neutral) scorer.

    ``load_model()`` runs once per task; the returned callable receives a list of
    texts (one Arrow batch) and returns one dict of class scores per text.  If it
    fails on a batch, the batch is scored text by text and a text on which it
    fails again gets the fixed neutral row.
    """
    def guarded(model, texts: list[str]) -> list[dict]:
        try:
            return model(texts)
        except Exception:  # noqa: BLE001 - whatever a caller's model raises on one text
            if len(texts) == 1:
                return [dict(NEUTRAL_SCORES)]
            return [row for t in texts for row in guarded(model, [t])]

    @F.pandas_udf(CLASS_SCORES)
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for texts in batches:
            rows = guarded(model, texts.fillna("").astype(str).tolist())
            yield pd.DataFrame({k: [float(r.get(k, 0.0)) for r in rows]
                                for k in ("positive", "negative", "neutral")})

    return _score


def pandas_encoder(load_model: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """Turn an embedding-model factory into a Column -> array<float> encoder."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").astype(str).tolist()))

    return _encode
