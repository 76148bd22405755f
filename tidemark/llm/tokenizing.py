"""Segment-wise encoding with a public byte-pair tokenizer file.

Both tokenizer files used here treat white space the same way: no token crosses
a position where a non-space character is followed by a space, tab or line end.
Their split patterns match left to right without look-behind, and every
alternative that takes a non-space character stops before white space, so
whatever the left context is, one match ends and the next begins there.  An
added special string holds no white space, so it never spans such a position
either.  The ids of a text are therefore the concatenated ids of the segments
between these positions, and equal segments have equal ids.
"""

from __future__ import annotations

import os
import re
from array import array

#: Runs of [space, tab, line ends] followed by other characters.
_PLAIN = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space other than those four: a segment may not end behind one.
_ODD = re.compile(r"[^\S \t\n\r]")
_STABLE = re.compile(r"(?<=\S)(?=[ \t\n\r])")

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per Python worker; one thread, as the
    task has one core."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def stable_segments(text: str) -> list[str]:
    """``text`` cut at every proven stable boundary (concatenated: the text)."""
    if _ODD.search(text):
        return _STABLE.split(text)
    return _PLAIN.findall(text)


class SegmentCache:
    """Segment -> value, filled in batches by ``compute`` and shared by all tasks
    of one Python worker.  Memory is bounded: past ``most`` entries the older
    generation is dropped and only segments met again are kept."""

    def __init__(self, compute, most: int = 400_000):
        self._compute, self._half = compute, most // 2
        self._new: dict = {}
        self._old: dict = {}

    def lookup(self, segments: list[str]) -> list:
        new, old = self._new, self._old
        missing = []
        for s in set(segments):
            if s not in new:
                if s in old:
                    new[s] = old[s]
                else:
                    missing.append(s)
        if missing:
            new.update(zip(missing, self._compute(missing)))
        out = [new[s] for s in segments]
        if len(new) > self._half:
            self._old, self._new = new, {}
        return out


def ids_bytes(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if packed.itemsize != 4:
        raise RuntimeError("unsigned int is not 32 bits here")
    import sys

    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()
