"""Best-fit packing of tokenised documents by exact-complement hashing.

1. One pass tokenises every text and cuts the ids (end id appended) into pieces
   of at most ``capacity`` tokens: (doc, piece, start, length, crc32).  It is
   written once to the shared checkpoint folder; nothing is tokenised twice.
2. The plan works on the histogram of lengths alone: at most ``capacity`` rows,
   whatever the input (its proven bound).  Longest lengths are opened first; the
   gap that a length leaves is looked up among the sums of one, two and three
   available lengths, and as many sequences as the counts allow are filled
   exactly.  What finds no exact complement is packed best-fit, again by counts.
   Each step exhausts a length or leaves less than one sequence's worth of it, so
   the plan has a few rows per length.
3. Every piece gets a rank within its length from counts by (length, bucket) and a
   window inside one bucket, so a length that holds a third of all pieces is
   ranked by many tasks; its rank finds its sequence and offset in the plan.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tokenizing
from tidemark.llm.common import slices, small_batches, texts_of
from tidemark.session import checkpoint_dir

#: Buckets of one length when ranks are dealt out: so many at least, and one for each so many pieces.
RANK_BUCKETS = 64
BUCKET_PIECES = 500_000

# A chunk of letters (ASCII and Latin-1) with trailing punctuation: its pieces are known without the full pre-tokenizer.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?|*#$%&+()\"-]*)")
_CACHES: dict[str, tokenizing.SegmentCache] = {}


def _byte_alphabet() -> dict[int, str]:
    """Byte -> printable character of the byte-level alphabet: printable bytes stand
    for themselves, the others for the characters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()


def _encode_segments(path: str):
    """Ids (packed bytes) of white-space free segments.  Letters followed by
    punctuation, the bulk of any text, go straight to the file's merge model, which
    is what its normaliser (lower case) and pre-tokenizer (letters | punctuation)
    make of them; everything else takes the whole tokenizer."""
    parts: dict[str, bytes] = {}

    def piece(model, text: str) -> bytes:
        found = parts.get(text)
        if found is None:
            if len(parts) > 300_000:
                parts.clear()
            mapped = text.encode("utf-8").decode("latin-1").translate(_ALPHABET)
            found = parts[text] = tokenizing.ids_bytes([t.id for t in model.tokenize(mapped)])
        return found

    def compute(segments: list[str]) -> list[bytes]:
        tok = tokenizing.tokenizer(path)
        model = tok.model
        out, hard = [], []
        for s in segments:
            m = _SIMPLE.fullmatch(s)
            if m is None:
                hard.append(len(out))
                out.append(s)
            else:
                word, marks = m.groups()
                out.append((piece(model, word.lower()) if word else b"") + (piece(model, marks) if marks else b""))
        for lo in range(0, len(hard), 2000):
            at = hard[lo:lo + 2000]
            for i, e in zip(at, tok.encode_batch_fast([out[i] for i in at], add_special_tokens=False)):
                out[i] = tokenizing.ids_bytes(e.ids)
        return out
    return compute


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each whole text followed
    by ``end_id``, cut every ``capacity`` tokens.  Null text counts as empty (one
    piece holding the end id).  No shuffle."""
    small_batches(docs.sparkSession)
    tail = tokenizing.ids_bytes([end_id])
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _CACHES:
            _CACHES[tokenizer_path] = tokenizing.SegmentCache(_encode_segments(tokenizer_path))
        cache = _CACHES[tokenizer_path]
        for batch in batches:
            for part in slices(batch, "text"):
                row, no, start, length, crc = [], array("i"), array("q"), array("q"), array("q")
                for i, text in enumerate(texts_of(part)):
                    ids = b"".join(cache.lookup([w for s in tokenizing.stable_segments(text)
                                                 if (w := s.strip(" \t\n\r"))])) + tail
                    for n, at in enumerate(range(0, len(ids), step)):
                        cut = ids[at:at + step]
                        row.append(i)
                        no.append(n)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(no, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


class _Plan:
    """Counts by length turned into patterns: (lengths of one sequence, how many such sequences)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(counts)
        self.patterns: list[tuple[tuple[int, ...], int]] = []

    def _use(self, lengths: tuple[int, ...]) -> int:
        """Consume a combination as often as the counts allow."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(self.left.get(x, 0) // n for x, n in need.items())
        if times > 0:
            self.patterns.append((lengths, times))
            for x, n in need.items():
                self.left[x] -= n * times
                if not self.left[x]:
                    del self.left[x]
        return times

    def _fits(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left.get(x, 0) >= lengths.count(x) for x in set(lengths))

    def _complement(self, gap: int, base: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to ``gap`` exactly; longest first."""
        if self._fits((base, gap)):
            return (gap,)
        keys = sorted(self.left)
        for a in reversed(keys[:bisect_left(keys, gap)]):          # pair sums
            if 2 * a < gap:
                break
            if gap - a in self.left and self._fits((base, a, gap - a)):
                return (a, gap - a)
        for a in reversed(keys[:bisect_left(keys, gap)]):          # triple sums
            if 3 * a < gap:
                break
            rest = gap - a
            for b in reversed(keys[:bisect_left(keys, min(rest, a + 1))]):
                if 2 * b < rest:
                    break
                if rest - b in self.left and self._fits((base, a, b, rest - b)):
                    return (a, b, rest - b)
        return None

    def run(self) -> list[tuple[tuple[int, ...], int]]:
        if self.left.get(self.capacity):
            self._use((self.capacity,))
        residual: dict[int, int] = {}
        while self.left:                                           # exact complements, longest first
            x = max(self.left)
            found = self._complement(self.capacity - x, x)
            if found is None:
                residual[x] = self.left.pop(x)
            else:
                self._use((x, *found))
        self._best_fit(residual)
        return self.patterns

    def _best_fit(self, counts: dict[int, int]) -> None:
        """Decreasing best fit by counts: equal open sequences are filled together."""
        open_by_gap: dict[int, list[list]] = {}
        gaps: list[int] = []                                       # sorted gaps with open sequences

        def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
            if gap not in open_by_gap:
                open_by_gap[gap] = []
                gaps.insert(bisect_left(gaps, gap), gap)
            open_by_gap[gap].append([lengths, times])

        for x in sorted(counts, reverse=True):
            todo = counts[x]
            while todo:
                at = bisect_left(gaps, x)
                if at == len(gaps):                                # no open sequence takes it
                    per = self.capacity // x
                    full, rest = divmod(todo, per)
                    if full:
                        put(self.capacity - per * x, (x,) * per, full)
                    if rest:
                        put(self.capacity - rest * x, (x,) * rest, 1)
                    break
                gap = gaps[at]
                lengths, times = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    del open_by_gap[gap]
                    gaps.pop(at)
                per = min(gap // x, todo)
                used = min(times, todo // per)
                todo -= used * per
                put(gap - per * x, lengths + (x,) * per, used)
                if times > used:
                    put(gap, lengths, times - used)
        for found in open_by_gap.values():
            for lengths, times in found:
                self.patterns.append((lengths, times))


def plan_rows(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, first_sequence, per_sequence, offset) rows that
    place every rank of every length exactly once."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    taken: dict[int, int] = {}
    first = 0
    for lengths, times in _Plan(counts, capacity).run():
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            per = lengths.count(x)
            at = taken.get(x, 0)
            rows.append((x, at, at + per * times, first, per, offset))
            taken[x] = at + per * times
            offset += per * x
        first += times
    return rows


def pack(piece_rows: DataFrame, capacity: int = 4096) -> DataFrame:
    """``piece_rows`` (from :func:`pieces`) plus sequence_id and offset.

    An empty table gives an empty result.  Repeated rows are packed as separate
    pieces.  ``piece_rows`` is written once to the shared checkpoint folder.
    """
    spark = piece_rows.sparkSession
    checkpoint_dir(spark)
    held = piece_rows.checkpoint(eager=True)

    # at most ``capacity`` rows whatever the input
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(RANK_BUCKETS, sum(counts.values()) // BUCKET_PIECES)
    held = held.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (held.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    plan = spark.createDataFrame(plan_rows(counts, capacity),
                                 "length bigint, _from bigint, _to bigint, _seq bigint, _per bigint, _at bigint")
    # a few rows per length: bounded by the capacity, not by the data
    per_length = plan.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("_from", "_to", "_seq", "_per", "_at"))).alias("_slots"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (held.withColumn("_k", F.row_number().over(within) - 1)
              .join(starts, ["length", "_bucket"])
              .withColumn("_rank", F.col("_base") + F.col("_k"))
              .join(F.broadcast(per_length), "length"))
    slot = F.filter("_slots", lambda s: (s["_from"] <= F.col("_rank")) & (F.col("_rank") < s["_to"]))[0]
    placed = ranked.withColumn("_s", slot)
    inside = F.col("_rank") - F.col("_s._from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_s._seq") + F.floor(inside / F.col("_s._per"))).cast("bigint").alias("sequence_id"),
        (F.col("_s._at") + F.pmod(inside, F.col("_s._per")) * F.col("length")).cast("bigint").alias("offset"))


def best_fit_pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty and still yields the end id; null ids and repeated
    rows are packed like any other; other columns are ignored; an empty table
    gives no rows."""
    return pack(pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id,
                       id_col=id_col, text_col=text_col), capacity)
