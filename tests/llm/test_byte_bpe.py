"""Byte-level BPE against the tiktoken library."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from llm_cases import EDGE, edge, empty, small_docs  # noqa: F401
from tidemark.llm import byte_bpe as B
from tidemark.llm import queries

PATH = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.ranks(PATH),
                             special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def digests(df):
    return sorted(((r.doc_id, (r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in df.collect()), key=repr)


def test_whole_table_equals_the_library(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = digests(queries.QUERIES["op11_byte_bpe"](spark, "/root/testdata/sf0.01"))
    assert got == sorted(((r.doc_id, expected(library, r.text)) for r in rows), key=repr)


def test_edges_keep_every_row(edge, empty, library):
    got = digests(B.digest(B.decode(B.encode(edge, PATH, public_tokenizers.PATTERN), PATH)))
    assert got == sorted(((r[0], expected(library, r[1])) for r in EDGE), key=repr)
    assert digests(B.digest(B.decode(B.encode(empty, PATH, public_tokenizers.PATTERN), PATH))) == []


def test_random_texts_equal_the_library(library):
    rng = random.Random(5)
    alphabets = ["ab", "aeiou thest'sll", "éüß \n\t\r", "0123456789 .,-", "\U0001f600中文 \x1c\x85 　x",
                 "".join(map(chr, range(32, 127)))]
    for n in range(600):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randrange(0, 120)))
        packed = B.encode_text(text, PATH, public_tokenizers.PATTERN)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode_ordinary(text), text
        assert B.decode_ids(packed, PATH) == text.encode()


def test_one_match_of_many_bytes(library):
    for text in ("a" * 30_000, "ab" * 9_000 + "c", "xyz" * 7_001):
        assert B.merge(text.encode(), B.ranks(PATH)) == library.encode_ordinary(text)


def test_leftmost_of_equal_ranks_is_merged_first():
    table = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"ba": 257}
    assert B.merge(b"aaa", table) == [256, 97]
    assert B.merge(b"baa", table) == [98, 256]


def test_blocks_change_no_id(library):
    text = " ".join(["word", "l'été ", "\n\n12 3", "x" * 50]) * 40
    assert "".join(B.blocks(text, 7)) == text
    whole = [t for part in B.blocks(text, 7) for t in library.encode_ordinary(part)]
    assert whole == library.encode_ordinary(text)


def test_tree_updates_follow_the_minimum():
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 8, 13):
        keys = [rng.randrange(100) for _ in range(n)]
        tree = B.PairTree(list(keys))
        for _ in range(50):
            at, key = rng.randrange(n), rng.choice([rng.randrange(100), B.PairTree.NONE])
            keys[at] = key
            tree.update(at, key)
            assert tree.least() == min(keys)
