"""Substring deduplication with suffix automata of reference shards.

A window of ``WINDOW`` words is repeated if its word sequence also starts earlier
(smaller document id, or earlier in the same document); every word that a
repeated window covers is removed.  The reference is the corpus itself, so its
automata cannot all be sent to all documents; both meet by key instead:

1. Every window has an anchor, the ``ANCHOR`` consecutive words in it with the least
   hash.  Equal windows have equal anchors, so only windows of one anchor need to
   meet.  Consecutive windows with the same anchor form a passage.
2. Anchors that occur once are dropped.  Equal passages of an anchor form a class that
   is represented by its first occurrence; every later one is repeated as a whole.
3. The classes of one anchor are a reference shard.  They are streamed in document
   order through the suffix automaton of the classes before them: where the matching
   statistic (the longest suffix read so far that the automaton contains) reaches
   the window, the window starts earlier.  Then the passage itself joins the automaton.
   The words of the passages are the texts' own, fetched from the documents.
4. Covered word ranges go back to the documents by id and are cut out of the texts.

Copies of an anchor are counted by partial sums and joined, never collected.  At the
edges of a shared passage, though, the passages reach into each document's own words,
and every document is a class of its own.  An anchor with more than ``SHARD`` classes
is therefore no shard: step 3 takes its windows one by one instead, keyed by anchor and
window hash; the first occurrence of each is a partial minimum, and a join finds the
later ones.  So no automaton holds more than ``SHARD`` passages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, texts_of
from tidemark.llm.wordhash import hashed_words, mix
from tidemark.session import cut_lineage, free_finished

WINDOW = 20
ANCHOR = 8
#: Classes that go through one automaton; the windows of anchors with more are joined.
SHARD = 1_000
_WORDS = re.compile(r"[^ \t-\r]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _spans(h: np.ndarray):
    """Hash of the words from each ``lo`` to before each ``hi``."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), _BASE)]))
        back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), _INVERSE)]))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1])])

    def span(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((upto[hi] - upto[lo]) * back[lo] + (hi - lo).astype(np.uint64))

    return span


def passages(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, passage hash, first window, windows) of each passage of a text."""
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    span = _spans(h)
    at = np.arange(len(h) - anchor + 1)
    grams = span(at, at + anchor)
    least = at[:n] + np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1).argmin(1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    windows = np.diff(np.concatenate([first, [n]]))
    return grams[least[first]], span(first, first + windows + window - 1), first, windows


class SuffixAutomaton:
    """Suffix automaton of a growing set of word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:                              # generalised: the sequence is known so far
            q = nxt[last][w]
            return q if length[last] + 1 == length[q] else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[p] + 1 == length[q] else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def statistics(self, words: list) -> Iterator[int]:
        """For each position the length of the longest suffix read so far that occurs in
        the automaton."""
        state = matched = 0
        nxt, link, length = self.next, self.link, self.length
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            yield matched


def covered(automaton: SuffixAutomaton, words: list, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal word ranges of a passage that windows known to the automaton cover."""
    out: list[list[int]] = []
    for end, matched in enumerate(automaton.statistics(words), 1):
        if matched >= window:
            if out and out[-1][1] >= end - window:
                out[-1][1] = end
            else:
                out.append([end - window, end])
    return [(a, b) for a, b in out]


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [passages(h, window) for h in hashed_words(part.column("text"))]
                each = [len(f[0]) for f in found]
                docs = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), each)
                cols = [np.concatenate([f[i] for f in found]) for i in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(docs),
                     pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))],
                    names=["anchor", "passage", "doc", "at", "windows"])
    return run


def _fetch(window: int):
    """The words of wanted passages; of hot ones each window, with its hash instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                for no, (doc, text, wanted) in enumerate(zip(part.column("doc_id").to_pylist(), texts_of(part),
                                                             part.column("wanted").to_pylist())):
                    words = _WORDS.findall(text)
                    rows += [(x["anchor"], x["passage"], doc, x["at"],
                              " ".join(words[x["at"]:x["at"] + x["windows"] + window - 1])) for x in wanted if not x["hot"]]
                    hot = [x for x in wanted if x["hot"]]
                    if hot:
                        h = hashed_words(part.column("text").slice(no, 1))[0]
                        starts = np.concatenate([np.arange(x["at"], x["at"] + x["windows"]) for x in hot])
                        anchors = np.repeat([x["anchor"] for x in hot], [x["windows"] for x in hot])
                        fits = starts <= len(h) - window        # another text under this id may be shorter
                        starts, anchors = starts[fits], anchors[fits]
                        keys = _spans(h)(starts, starts + window).view(np.int64)
                        rows += [(a, k, doc, s, None) for a, k, s in zip(anchors.tolist(), keys.tolist(), starts.tolist())]
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))],
                    names=["anchor", "passage", "doc", "at", "words"])
    return run


def _stream(window: int):
    """Rows sorted by (anchor, doc, at, passage), repeated ones skipped: each shard through
    its growing automaton."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = automaton = before = None
        for batch in batches:
            docs, lows, highs = [], [], []
            for key, passage, doc, at, text in zip(*(batch.column(c).to_pylist() for c in (
                    "anchor", "passage", "doc", "at", "words"))):
                if (key, passage, doc, at) == before:
                    continue
                before = key, passage, doc, at
                words = text.split(" ")
                if key != anchor:
                    anchor, automaton = key, SuffixAutomaton()
                else:
                    for a, b in covered(automaton, words, window):
                        docs.append(doc)
                        lows.append(at + a)
                        highs.append(at + b)
                automaton.add(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())],
                names=["doc", "low", "high"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(texts_of(part), part.column("spans").to_pylist()):
                words = _WORDS.findall(text)
                n_words.append(len(words))
                if spans:
                    keep, at = [], 0
                    for s in sorted(spans, key=lambda s: (s["low"], s["high"])):
                        if s["low"] > at:
                            keep += words[at:s["low"]]
                        at = max(at, s["high"])
                    words = keep + words[at:]
                n_removed.append(n_words[-1] - len(words))
                kept.append(" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def _shared(rows: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Passages whose anchor occurs more than once, and their classes with the first occurrence."""
    found = rows.mapInArrow(_anchors(window), "anchor bigint, passage bigint, doc bigint, at int, windows int")
    # cut off, so that the join below is dealt out by an exchange of its own and a hot anchor is split
    often = cut_lineage(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    free_finished(rows.sparkSession)
    shared = cut_lineage(found.join(often, "anchor"))
    del often
    free_finished(rows.sparkSession)
    classes = cut_lineage(shared.groupBy("anchor", "passage", "windows").agg(
        F.min(F.struct("doc", "at")).alias("first")))
    free_finished(rows.sparkSession)
    return shared, classes


def _fetched(rows: DataFrame, classes: DataFrame, window: int, shard: int) -> DataFrame:
    """(anchor, passage, doc, at, words): the classes of anchors with several of them; each
    window of those with more than ``shard``, its hash as ``passage`` and no words."""
    several = cut_lineage(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    wanted = classes.join(several, "anchor").groupBy(F.col("first.doc").alias("wanted_by")).agg(
        F.collect_list(F.struct("anchor", "passage", F.col("first.at").alias("at"), "windows",
                                (F.col("n") > shard).alias("hot"))).alias("wanted"))
    return rows.join(wanted, F.col("doc_id") == F.col("wanted_by")).select("doc_id", "text", "wanted").mapInArrow(
        _fetch(window), "anchor bigint, passage bigint, doc bigint, at int, words string")


def repeated_spans(rows: DataFrame, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """(doc, low, high): word ranges of ``rows`` (doc_id, text) that repeated windows cover."""
    shared, classes = _shared(rows, window)
    fetched = cut_lineage(_fetched(rows, classes, window, shard))
    free_finished(rows.sparkSession)
    within = (fetched.where("words is not null").repartition("anchor")
              .sortWithinPartitions("anchor", "doc", "at", "passage")
              .mapInArrow(_stream(window), "doc bigint, low int, high int"))
    single = fetched.where("words is null").select("anchor", F.col("passage").alias("hash"), "doc", "at")
    # cut off for the same reason: a window in very many classes is split
    begun = cut_lineage(single.groupBy("anchor", "hash").agg(
        F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    again = single.join(begun, ["anchor", "hash"]).where(
        (F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at"))).select(
        "doc", F.col("at").alias("low"), (F.col("at") + window).alias("high"))
    keys = ["anchor", "passage", "windows"]
    later = shared.join(classes, keys).where(
        (F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at"))).select(
        "doc", F.col("at").alias("low"), (F.col("at") + F.col("windows") + (window - 1)).alias("high"))
    return within.unionByName(again).unionByName(later)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row; ``kept`` is what is left, its words
    joined by one space.

    Null and blank texts have no words; texts shorter than the window keep all of
    theirs.  Ids are expected to be unique: rows that repeat an id and text do not
    repeat each other, and of different texts under one id each loses the ranges found
    in either.  Rows with a null id neither lose words nor make others lose them.  Other
    columns are ignored; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    known = rows.where("doc_id is not null")
    # a document's own ranges: bounded by its length
    spans = repeated_spans(known, window).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    cut = known.join(spans, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans")
    return cut.mapInArrow(_cut, schema).unionByName(
        rows.where("doc_id is null").withColumn("spans", F.lit(None).cast(cut.schema["spans"].dataType))
        .mapInArrow(_cut, schema))


def digest(deduplicated: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    return deduplicated.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
