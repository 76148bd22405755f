"""Byte-level BPE encoding and decoding with a rank file.

A text is cut into the matches of a split pattern; each match is encoded on its
own.  :func:`merge` keeps a segment tree over the byte positions of a match: the
leaf of a live token holds the rank of the pair it makes with its right
neighbour, every inner node the least (rank, position) below it, so the root is
the leftmost pair of the least rank.  A merge is three point updates, of the pair
that grew, of the one on its left and of the one that vanished, each as long as
the tree is high.  A match of n bytes takes O(n log n), whatever its content.

Equal matches are encoded once per Python worker (a bounded cache).  A text is
taken in blocks that end where a non-space is followed by a space, tab or line
end; there one match ends and the next begins, so blocks change no id and memory
does not follow the number of matches of the longest text.

Documents are independent: encoding and decoding are one pass each and shuffle
nothing.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokenizing
from tidemark.llm.common import slices, texts_of

#: Characters of a text that are split into matches at a time.
BLOCK_CHARS = 1_000_000

_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")
_RANKS: dict[str, dict[bytes, int]] = {}
_VOCABULARY: dict[str, list[bytes]] = {}
_ENCODERS: dict[tuple[str, str], tuple] = {}


def ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a rank file (base64 token, rank in each line), loaded once per worker."""
    if path not in _RANKS:
        with open(path, "rb") as lines:
            _RANKS[path] = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return _RANKS[path]


def vocabulary(path: str) -> list[bytes]:
    """Rank -> token; ranks that the file lacks stand for nothing."""
    if path not in _VOCABULARY:
        by_token = ranks(path)
        table = [b""] * (max(by_token.values(), default=-1) + 1)
        for token, rank in by_token.items():
            table[rank] = token
        _VOCABULARY[path] = table
    return _VOCABULARY[path]


class PairTree:
    """Least key over positions 0..n-1 with point updates; ``NONE`` marks a dead position."""

    NONE = sys.maxsize

    def __init__(self, keys: list[int]):
        self.n = len(keys)
        self.node = [self.NONE] * self.n + keys
        for i in range(self.n - 1, 0, -1):
            left, right = self.node[2 * i], self.node[2 * i + 1]
            self.node[i] = left if left < right else right

    def least(self) -> int:
        return self.node[1]

    def update(self, position: int, key: int) -> None:
        node, i = self.node, position + self.n
        node[i] = key
        while i > 1:
            other = node[i ^ 1]
            key = key if key < other else other
            i >>= 1
            if node[i] == key:
                return
            node[i] = key


def merge(piece: bytes, table: dict[bytes, int]) -> list[int]:
    """Ids of one match: a whole token if the table has it, else the leftmost pair of
    the least rank is merged until no neighbours make a token."""
    whole = table.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    none = PairTree.NONE
    end = list(range(1, n + 1))        # a live token's end, by its first byte
    before = list(range(-1, n))        # first byte of the token that ends where this one starts

    def key(start: int) -> int:
        """(rank, position) of the pair that begins at ``start``, as one number."""
        middle = end[start]
        if middle >= n:
            return none
        rank = table.get(piece[start:end[middle]])
        return none if rank is None else rank * n + start

    tree = PairTree([key(i) for i in range(n)])
    while tree.least() != none:
        at = tree.least() % n
        gone = end[at]
        end[at] = end[gone]
        before[end[gone]] = at
        tree.update(gone, none)
        tree.update(at, key(at))
        if before[at] >= 0:
            tree.update(before[at], key(before[at]))
    out, i = [], 0
    while i < n:
        out.append(table[piece[i:end[i]]])
        i = end[i]
    return out


def blocks(text: str, most: int = BLOCK_CHARS) -> Iterator[str]:
    """Consecutive parts of a text, cut at the first safe place after ``most`` characters."""
    start = 0
    while len(text) - start > most:
        cut = _CUT.search(text, start + most)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def _encoder(path: str, pattern: str):
    """(split function, cache of match -> packed ids) of this worker."""
    if (path, pattern) not in _ENCODERS:
        import regex

        table = ranks(path)
        cache = tokenizing.SegmentCache(
            lambda found: [tokenizing.ids_bytes(merge(s.encode("utf-8"), table)) for s in found])
        _ENCODERS[path, pattern] = regex.compile(pattern).findall, cache
    return _ENCODERS[path, pattern]


def encode_text(text: str, path: str, pattern: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    split, cache = _encoder(path, pattern)
    return b"".join(b"".join(cache.lookup(split(part))) for part in blocks(text))


def decode_ids(packed: bytes, path: str) -> bytes:
    """Bytes of packed ids."""
    ids = array("I")
    ids.frombytes(packed)
    if sys.byteorder == "big":
        ids.byteswap()
    return b"".join(map(vocabulary(path).__getitem__, ids))


def encode(docs: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text, little-endian unsigned 32-bit, as binary.

    Null text counts as empty and has no ids; null ids and repeated rows are kept;
    other columns are ignored; an empty table gives no rows.  ``rank_path`` must
    exist on every executor and hold all 256 single bytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [encode_text(text, rank_path, pattern) for text in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())],
                                                 names=["doc_id", "ids"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """(doc_id, ids, bytes): the bytes that each row's ids stand for; null ids count as none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                ids = [i or b"" for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.binary()),
                     pa.array([decode_ids(i, rank_path) for i in ids], pa.binary())],
                    names=["doc_id", "ids", "bytes"])

    src = encoded.select("doc_id", "ids")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids binary, bytes binary")


def digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of :func:`decode` rows."""
    return decoded.select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
