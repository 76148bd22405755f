"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly.

A word is the mean of the vectors of its character n-grams (hashed buckets) and
of the word itself; a passage of ``window`` words is the mean of its words; a
linear softmax on it gives the probability of label 1, and a text scores as its
most toxic passage.  An unseen spelling shares most n-grams, hence most of its
vector, with the word it varies.  Vectors and softmax are trained together in
numpy on a bounded sample of labelled rows; after a first round on all passages,
a toxic text teaches through its highest-scoring passage only.

Prediction folds vectors and softmax into one number per word, so a text costs
one look-up per word: one pass over the documents, no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, slices, texts_of

#: Bound of the training sample: so many labelled documents of label 1 and of label 0.
SAMPLE_BY_LABEL = (1500, 4500)
#: Characters of a text that is learnt from, at most.
SAMPLE_CHARS = 200_000
BUCKETS = 1 << 17
DIMENSION = 8
WINDOW = 16
ORDERS = (3, 4, 5)
_WORD = re.compile(r"\w+")
#: Distinct words whose logit a worker remembers, by model.
CACHE_WORDS = 400_000
_CACHES: dict[int, dict[str, float]] = {}


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, how many per word): for each word in turn, the buckets of the word
    itself and of its character n-grams between boundary marks."""
    marked = [f"<{w}>" for w in words]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(marked)), length)
    owners = [np.arange(len(marked))]
    buckets = [np.fromiter((zlib.crc32(m.encode("utf-8", "surrogatepass")) % BUCKETS for m in marked),
                           np.int64, len(marked))]
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h ^ codes[i:len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = of[:len(h)] == of[n - 1:]
            owners.append(of[:len(h)][inside])
            buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.bincount(owner, minlength=len(marked))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class ToxicityModel:
    weight: np.ndarray             # per bucket: its vector times the softmax direction
    bias: float

    def key(self) -> int:
        """The same for equal models: a worker's remembered logits are kept by it."""
        return zlib.crc32(self.weight.tobytes()) * 31 + hash(self.bias)

    def word_logits(self, words: list[str]) -> np.ndarray:
        bucket, n = subwords(words)
        return np.add.reduceat(self.weight[bucket], np.cumsum(n) - n) / n

    def logit(self, text: str, cache: dict[str, float]) -> float:
        """Logit of the most toxic passage; a text without words is an empty passage
        (the bias alone)."""
        found = words_of(text)
        if not found:
            return self.bias
        if len(cache) > CACHE_WORDS:
            cache.clear()
        missing = [w for w in set(found) if w not in cache]
        if missing:
            cache.update(zip(missing, self.word_logits(missing).tolist()))
        values = np.fromiter((cache[w] for w in found), float, len(found))
        starts = np.arange(0, len(values), WINDOW)
        sums = np.add.reduceat(values, starts)
        return float((sums / np.minimum(WINDOW, len(values) - starts)).max()) + self.bias

    def score(self, text: str, cache: dict[str, float]) -> float:
        """Probability of label 1."""
        return _sigmoid(self.logit(text, cache))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


def calibrated(model: ToxicityModel, texts: list[str], labels: list[int]) -> ToxicityModel:
    """The bias moved to where texts that the fit has not seen separate best: the
    middle of the widest range of thresholds with the least balanced error."""
    cache: dict[str, float] = {}
    z = np.array([model.logit(t, cache) for t in texts])
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return model
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    missed = np.concatenate([[0], np.cumsum(y == 1)]) / (y == 1).sum()
    raised = 1 - np.concatenate([[0], np.cumsum(y == 0)]) / (y == 0).sum()
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    width = np.diff(edges)
    error = np.where(width > 0, missed + raised, np.inf)
    best = np.flatnonzero(error <= error.min() + 1e-12)
    at = best[np.argmax(width[best])]
    return ToxicityModel(model.weight, model.bias - float(edges[at] + edges[at + 1]) / 2)


def train(texts: list[str], labels: list[int], *, epochs: int = 8, batch: int = 64, rate: float = 0.5,
          seed: int = 7) -> ToxicityModel:
    """Fit on (text, 0/1) rows, every fifth kept back for :func:`calibrated`.  One
    class or no rows: a constant model."""
    kept = [i for i in range(len(texts)) if i % 5]
    if len(texts) < 50:
        return _train(texts, labels, epochs, batch, rate, seed)
    model = _train([texts[i] for i in kept], [labels[i] for i in kept], epochs, batch, rate, seed)
    return calibrated(model, texts[::5], labels[::5])


def _train(texts: list[str], labels: list[int], epochs: int, batch: int, rate: float, seed: int) -> ToxicityModel:
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(BUCKETS), 6.0 if len(y) and y[0] == 1 else -6.0)
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    flat, n_words = [], []
    for text in texts:
        ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)), np.int32)
        flat.append(ids)
        n_words.append(len(ids))
    word_at, length = np.concatenate(flat), np.array(n_words, np.int64)
    if not len(word_at):
        return ToxicityModel(np.zeros(BUCKETS), 0.0)
    each = -(-length // WINDOW)
    doc = np.repeat(np.arange(len(texts)), each)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    begin = np.repeat(np.cumsum(length) - length, each) + number * WINDOW
    size = np.minimum(WINDOW, np.repeat(length, each) - number * WINDOW)
    known = list(vocabulary)
    parts = [subwords(known[i:i + 20_000]) for i in range(0, len(known), 20_000)]
    bag = np.concatenate([p[0].astype(np.int32) for p in parts])
    bag_size = np.concatenate([p[1] for p in parts])
    del parts, known, vocabulary, flat
    bag_at = np.cumsum(bag_size) - bag_size

    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSION))
    softmax = rng.normal(0, 0.1, (DIMENSION, 2))
    bias = np.zeros(2)
    squares = [np.full(BUCKETS, 1e-6), np.full_like(softmax, 1e-6), np.full_like(bias, 1e-6)]

    def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
        ends = np.cumsum(length)
        return np.arange(ends[-1]) + np.repeat(start - (ends - length), length)

    def logits() -> np.ndarray:
        direction = vectors @ (softmax[:, 1] - softmax[:, 0])
        per_word = np.add.reduceat(direction[bag], bag_at) / bag_size
        return np.add.reduceat(per_word[word_at], begin) / size + bias[1] - bias[0]

    share = np.array([(y == 0).mean(), (y == 1).mean()])
    for epoch in range(epochs):
        if epoch < 2:
            chosen = np.arange(len(begin))
        else:                      # toxic texts: their top passage; the others: top and one passage in four
            z = logits()
            order = np.lexsort((z, doc))
            last = order[np.flatnonzero(np.r_[doc[order][1:] != doc[order][:-1], True])]
            extra = np.flatnonzero((y[doc] == 0) & (rng.random(len(doc)) < 0.25))
            chosen = np.unique(np.concatenate([last, extra]))
        chosen = rng.permutation(chosen)
        for lo in range(0, len(chosen), batch):
            win = chosen[lo:lo + batch]
            n_words = size[win]
            w = word_at[ranges(begin[win], n_words)]
            n_ids = bag_size[w]
            ids = bag[ranges(bag_at[w], n_ids)]
            scale = np.repeat(1 / n_ids, n_ids) * np.repeat(np.repeat(1 / n_words, n_words), n_ids)
            in_window = np.repeat(np.repeat(np.arange(len(win)), n_words), n_ids)
            x = np.zeros((len(win), DIMENSION))
            for d in range(DIMENSION):
                x[:, d] = np.bincount(in_window, vectors[ids, d] * scale, len(win))
            z = x @ softmax + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            target = y[doc[win]]
            p[np.arange(len(win)), target] -= 1
            g = p * (0.5 / share[target])[:, None] / len(win)
            hidden = g @ softmax.T
            unique, back = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(back, hidden[in_window, d] * scale, len(unique))
                             for d in range(DIMENSION)], 1)
            squares[0][unique] += (grad ** 2).mean(1)
            vectors[unique] -= rate * grad / np.sqrt(squares[0][unique])[:, None]
            for value, step, seen in ((softmax, x.T @ g, squares[1]), (bias, g.sum(0), squares[2])):
                seen += step ** 2
                value -= 0.2 * rate * step / np.sqrt(seen)
    return ToxicityModel(vectors @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]))


def training_sample(docs: DataFrame, labels: DataFrame, *, by_label: tuple[int, int] = SAMPLE_BY_LABEL,
                    most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(text, label) of the labelled documents, ``by_label`` of label 1 and 0 at most, drawn
    by a hash of the id from those whose crc32(doc_id) mod 5 is not 0.  Rows
    with a null text, id or label, and texts over ``most_chars`` characters, teach nothing; a
    repeated document or label row counts as often as it is there, within the same bounds."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & (crc_mod(F.col("doc_id"), 5) != 0))
    drawn = None
    for label, most in zip((1, 0), by_label):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        drawn = part if drawn is None else drawn.unionByName(part)
    # broadcast: sum(by_label) rows at most, so no text is shuffled
    drawn = F.broadcast(drawn)
    met = docs.select("doc_id", "text").where(F.length("text") <= most_chars).join(drawn, "doc_id")
    bounded = None
    for label, most in zip((1, 0), by_label):              # ids may repeat: the bound holds for what is collected
        part = met.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(most)
        bounded = part if bounded is None else bounded.unionByName(part)
    return bounded.select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, *, by_label: tuple[int, int] = SAMPLE_BY_LABEL) -> ToxicityModel:
    # bounded by ``by_label``
    rows = sorted((r["text"], r["label"]) for r in training_sample(docs, labels, by_label=by_label).collect())
    return train([t for t, _ in rows], [x for _, x in rows])


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row; null text counts as empty; repeated
    rows and null ids are kept; other columns are ignored."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), model.key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _CACHES.setdefault(key, {})
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                got = [model.score(t, cache) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got, pa.float64())],
                                                 names=["doc_id", "score"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {id_type}, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
