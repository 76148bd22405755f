"""Token counts and packing against the tokenizer files themselves."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer
from llm_cases import edge, empty, small_docs  # noqa: F401

from tidemark.llm import packing, token_counts, tokenizing

BYTE, WORD = str(P.path("byte_bpe_50k.json")), str(P.path("word_bpe_49k.json"))
ODD = ["a  b", "a   b", "a   b", "x\x1cy z", "tail  ", "  head", "it's we'll 'S", "<|endoftext|> a<|endoftext|>b",
       "Ünïcode ÀÉ ß 漢字 😀 12 3.5", "á éx", "ΣΑΣ ας Σ.", "\n\n\tx\r\n\r\ny", "don't…“q”", ""]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_segments_concatenate_to_the_whole(path):
    tok = Tokenizer.from_file(path)
    for text in ODD + [" ".join(ODD)]:
        segments = tokenizing.stable_segments(text)
        assert "".join(segments) == text
        whole = tok.encode(text, add_special_tokens=False).ids
        assert [i for s in segments for i in tok.encode(s, add_special_tokens=False).ids] == whole


def test_spliced_counts_equal_whole_counts():
    tok = Tokenizer.from_file(BYTE)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ,.\n'sé  ") for _ in range(rng.randint(0, 900))) for _ in range(60)]
    texts += ["x" * 700, "ab" * 300 + " " + "c" * 400, " " * 500, ("word " * 50 + "y" * 300) * 3]
    for text in texts:
        for chunk, overlap in ((64, 8), (100, 1), (200, 64)):
            assert token_counts.spliced_count(tok, text, chunk, overlap) == len(tok.encode(text, add_special_tokens=False))


def test_count_tokens(edge, empty):
    tok = Tokenizer.from_file(BYTE)
    got = token_counts.count_tokens(edge, BYTE, chunk_chars=5000).collect()
    assert len(got) == edge.count()
    want = sorted((r.doc_id or 0, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False)))
                  for r in edge.collect())
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(empty, BYTE).count() == 0


def check_packing(rows, texts, capacity=4096):
    tok = Tokenizer.from_file(WORD)
    want = []
    for doc, text in texts:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(doc or 0, n, at, len(ids[at:at + capacity]), zlib.crc32(np.array(ids[at:at + capacity], "<u4").tobytes()))
                 for n, at in enumerate(range(0, len(ids), capacity))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packing_edge_rows(edge, empty):
    check_packing(packing.best_fit_pack(edge, WORD).collect(), [(r.doc_id, r.text) for r in edge.collect()])
    assert packing.best_fit_pack(empty, WORD).count() == 0


def test_packing_is_tight(small_docs):
    used, bound = check_packing(packing.best_fit_pack(small_docs, WORD).collect(),
                                [(r.doc_id, r.text) for r in small_docs.collect()])
    assert used <= bound + 2


def test_simple_segments_match_the_whole_tokenizer():
    tok = Tokenizer.from_file(WORD)
    words = ["Hello,", "ÀÉÎ", "straße.", "...", "a", "Z!?", "x***", "mid-dle", "it's", "l'a", "9", "ﬁ", "İ", "'s", ""]
    for w, ids in zip(words, packing._encode_segments(WORD)(words)):
        assert ids == tokenizing.ids_bytes(tok.encode(w, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(25))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 16, 64, 4096])
    counts = {}
    for _ in range(rng.randint(0, 200)):
        x = rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(1, max(1, capacity // 4))
        counts[x] = counts.get(x, 0) + rng.choice([1, 1, 2, 50])
    cover, fill = {}, {}
    for length, lo, hi, first, per, offset in packing.plan_rows(counts, capacity):
        cover.setdefault(length, []).append((lo, hi))
        for r in range(hi - lo):
            fill.setdefault(first + r // per, []).append((offset + r % per * length, length))
    for length, n in counts.items():
        at = 0
        for lo, hi in sorted(cover[length]):
            assert lo == at
            at = hi
        assert at == n
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(x * n for x, n in counts.items())
    assert len(fill) <= 2 * -(-total // capacity)


def test_exact_complements_come_first():
    assert packing._Plan({10: 3, 6: 3}, 16).run() == [((10, 6), 3)]
    assert packing._Plan({9: 2, 4: 2, 3: 2}, 16).run() == [((9, 4, 3), 2)]
    assert packing._Plan({7: 1, 4: 1, 3: 1, 2: 1}, 16).run() == [((7, 4, 3, 2), 1)]
