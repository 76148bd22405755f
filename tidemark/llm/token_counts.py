"""Token counts of whole texts; huge documents by overlap resynchronisation.

A document up to ``chunk_chars`` is encoded at once (its stable segments through
the worker's cache).  A longer one is encoded as chunks that overlap: each chunk
gives token end offsets; the two encodings of an overlap are spliced at a
position where both have a token boundary and which is proven stable
(``tokenizing``: a non-space followed by a space, tab or line end).  If the
overlap has no such position it is doubled, up to the rest of the text, so the
count always equals that of the text encoded whole.

Rows are independent: one pass over the documents without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokenizing
from tidemark.llm.common import slices, texts_of

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512

_BOUNDARY = re.compile(r"(?<=\S)(?=[ \t\n\r])")
_CACHES: dict[str, tokenizing.SegmentCache] = {}


def _ends(tok, text: str) -> list[int]:
    """Character end offset of each token of ``text``."""
    return [end for _, end in tok.encode(text, add_special_tokens=False).offsets]


def spliced_count(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text`` from overlapping chunks spliced at stable boundaries."""
    total, start = 0, 0            # text[:start] is counted
    while True:
        width = chunk
        while True:
            stop = min(start + width, len(text))
            left = _ends(tok, text[start:stop])
            if stop == len(text):
                return total + len(left)
            cut = _splice(tok, text, start, stop, left, overlap)
            if cut is not None:
                break
            width *= 2             # no common stable boundary even in the widest overlap
        total += bisect_right(left, cut - start)
        start = cut


def _splice(tok, text: str, start: int, stop: int, left: list[int], overlap: int) -> int | None:
    """A stable position inside the chunk's tail on which this chunk and the next
    one, begun ``overlap`` characters before the end, both have a token boundary."""
    boundaries = set(left)
    while True:
        begin = max(start, stop - overlap)
        marks = [m.start() for m in _BOUNDARY.finditer(text, begin + 1, stop)]
        if marks:
            # the next chunk's view of the overlap, past its own first stable position
            right = {begin + e for e in _ends(tok, text[begin:min(len(text), stop + overlap)])}
            for cut in reversed(marks):
                if cut in right and cut - start in boundaries and cut > start:
                    return cut
        if begin == start:
            return None
        overlap *= 2


def _count_segments(path: str):
    def compute(segments: list[str]) -> list[int]:
        tok = tokenizing.tokenizer(path)
        out: list[int] = []
        for i in range(0, len(segments), 2000):
            out += [len(e) for e in tok.encode_batch_fast(segments[i:i + 2000], add_special_tokens=False)]
        return out
    return compute


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512, chunk_chars: int = CHUNK_CHARS,
                 overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    Null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows
    are kept as they are; other columns are ignored.  ``over_limit`` is
    ``n_tokens > limit``.  ``tokenizer_path`` must exist on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizing.tokenizer(tokenizer_path)
        if tokenizer_path not in _CACHES:
            _CACHES[tokenizer_path] = tokenizing.SegmentCache(_count_segments(tokenizer_path))
        cache = _CACHES[tokenizer_path]
        for batch in batches:
            for part in slices(batch, "text"):
                n_bytes, n_tokens = [], []
                for text in texts_of(part):
                    n_bytes.append(len(text.encode("utf-8")))
                    n_tokens.append(spliced_count(tok, text, chunk_chars, overlap_chars)
                                    if len(text) > chunk_chars
                                    else sum(cache.lookup(tokenizing.stable_segments(text))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    out = src.mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
