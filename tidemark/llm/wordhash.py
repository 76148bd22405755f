"""64-bit hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: What ends a word besides the space.
_OTHER_BREAKS = "\t\n\x0b\x0c\r"


def hashed_words(texts: pa.Array, lower: bool = False) -> list[np.ndarray]:
    """For each text the hashes of its words (maximal runs without space, tab or line
    ends), A-Z lower-cased on request.  Null or blank texts have none.  A word that
    occurs often in ``texts`` is hashed once, from the bytes that Arrow holds."""
    filled = pc.fill_null(texts, "")
    if lower:
        filled = pc.ascii_lower(filled)
    for other in _OTHER_BREAKS:                            # one plain separator is cheaper to split at than a pattern
        filled = pc.replace_substring(filled, other, " ")
    split = pc.split_pattern(filled, " ")
    coded = split.flatten().dictionary_encode()
    ends, word_bytes = _raw(coded.dictionary)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, (word_bytes[a:b] for a, b in zip(ends, ends[1:]))),
                         np.uint64, len(coded.dictionary))
    index = coded.indices.to_numpy()
    filled_in = (np.diff(ends) > 0)[index]                 # between two breaks, and at either end, is no word
    upto = np.concatenate([[0], np.cumsum(filled_in)])[split.offsets.to_numpy()]
    words = hashed[index[filled_in]]
    return [words[a:b] for a, b in zip(upto[:-1], upto[1:])]


def _raw(strings: pa.StringArray) -> tuple[list[int], bytes]:
    """Where the strings end in their UTF-8 bytes, from 0 on, and these bytes."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32, len(strings) + 1, 4 * strings.offset) if len(strings) else np.zeros(1, np.int32)
    return (ends - ends[0]).tolist(), data.to_pybytes()[ends[0]:ends[-1]] if data is not None else b""


def mix(h: np.ndarray) -> np.ndarray:
    """Bit mixer for hashes that are sums of products."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))
