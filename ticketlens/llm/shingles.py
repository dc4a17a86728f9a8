"""Hashed word shingles of whole texts, many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z in lower case; white space becomes a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_PRIME = np.uint64(0x100000001B3)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has its whole sequence as one; a text without words has none. Words
    are hashed over their bytes, a shingle over the hashes of its words in order.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return [np.zeros(0, dtype=np.uint64) for _ in range(len(texts))]
    data = _FOLD[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = data != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # A word never runs over the border of two texts.
    borders = offsets[1:-1]
    borders = borders[borders < len(data)]
    first[borders] = inside[borders]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64) for _ in range(len(texts))]
    words = _word_hashes(data, inside, starts)
    of_text = np.searchsorted(starts, offsets)
    rolled = words.copy()
    for k in range(1, width):
        most = max(0, len(words) - k)
        rolled[:most] = mixed(rolled[:most] + np.uint64(k)) ^ words[k:]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = words[a : a + 1].copy()
            for k in range(1, b - a):
                whole = mixed(whole + np.uint64(k)) ^ words[a + k : a + k + 1]
            out.append(mixed(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _word_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a sum of mixed (byte, place in the word) codes."""
    # Bytes before the first word are white space and count for nothing.
    place = np.arange(len(data), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    codes = mixed((place.astype(np.uint64) << np.uint64(8)) + data + np.uint64(1)) * inside
    total = np.add.reduceat(codes, starts)
    return mixed(total * _PRIME)
