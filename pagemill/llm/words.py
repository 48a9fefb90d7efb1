"""Words of whole batches of texts as NumPy arrays.

A word is a maximal run of bytes other than space and U+0009..U+000D. In UTF-8 those six bytes never occur inside a longer
character, so words can be cut from bytes. A word's hash adds up values that look random for each place and letter (tabulation); runs
of words are hashed by joining halves with a mixer that is not linear. So no pattern of letters or words makes unlike ones
meet. Where equality itself counts, codes() tells words apart by their bytes, and digest() gives cryptographic keys.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    k, by = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
    h = h ^ (h >> by)
    h *= k
    h ^= h >> by
    h *= k
    h ^= h >> by
    return h


def _value(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return mix(mix((place.astype(np.uint64) << np.uint64(8) | letter.astype(np.uint64)) + BASE) + BASE)


#: Places of a word with values at hand, and these.
NEAR = 64
LETTERS = _value(np.repeat(np.arange(NEAR), 256), np.tile(np.arange(256), NEAR))


def digest(texts, size: int = 8) -> bytes:
    """Digests of byte strings, one after the other."""
    return b"".join([blake2b(t, digest_size=size).digest() for t in texts])


class Words:
    """Words of a string or binary array (null: no words).

    data: the bytes; start, end: of each word there; first: of each text its first word, with the total at the end.
    """

    def __init__(self, texts: pa.Array, tidy: bool = False, lower: bool = False):
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lo = int(offsets[0])
        data = np.frombuffer(data, np.uint8, int(offsets[-1]) - lo, lo) if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - lo
        if lower:
            data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
        space = SPACE[data]
        if tidy and len(data):
            data, offsets, space = self._tidy(data, offsets, space)
        self.inside = inside = ~space
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= space[:-1]
            ends[:-1] &= space[1:]
            cut = offsets[(offsets > 0) & (offsets < len(data))]
            begins[cut] |= inside[cut]
            ends[cut - 1] |= inside[cut - 1]
        self.data, self.offsets = data, offsets
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    @staticmethod
    def _tidy(data, offsets, space):
        """Every run of space within a text becomes one blank; none stays at a text's start."""
        keep = ~space
        keep[1:] |= ~space[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        keep[heads[space[heads]]] = False
        after = np.concatenate([[0], np.cumsum(keep)])
        return np.where(space, np.uint8(32), data)[keep], after[offsets], space[keep]

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """Of each word its number among the distinct words, and these; equal are words with equal bytes."""
        size = np.concatenate([[0], np.cumsum(self.end - self.start)])
        got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(size), pa.py_buffer(self.data[self.inside])]).dictionary_encode()
        return np.asarray(got.indices), got.dictionary

    def hashes(self) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        ends = np.cumsum(size)
        letter = self.data[self.inside]
        place = np.arange(len(letter), dtype=np.int32)
        place -= np.repeat((ends - size).astype(np.int32), size)
        near = np.minimum(place, NEAR - 1)
        near <<= 8
        near |= letter
        value = LETTERS.take(near)
        if int(size.max()) >= NEAR:
            far = np.flatnonzero(place >= NEAR - 1)
            value[far] = _value(place[far], letter[far])
        upto = np.cumsum(value)[ends - 1]
        total = size.astype(np.uint64)
        total += upto
        total[1:] -= upto[:-1]
        return mix(total)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values; shorter inputs have none. A run's hash joins those of its halves."""
    out, done, part, size, left = None, 0, h, 1, n
    while left:
        if left & 1:
            m = max(0, len(h) - done - size + 1)
            out = part[:m] if out is None else mix(out[:m] * BASE + part[done : done + m])
            done += size
        left >>= 1
        if left:
            m = max(0, len(part) - size)
            part, size = mix(part[:m] * BASE + part[size : size + m]), 2 * size
    return mix(out ^ np.uint64(n))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)
