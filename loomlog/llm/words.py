"""Words, shingles and character n-grams of many texts at once, as numpy arrays.

A slice of texts is one buffer of UTF-8 bytes.  Words are maximal runs of bytes
of one class; hashes of any byte range come from one running sum of
``byte * base**place`` (mod 2**64), so no Python string is made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)

#: Classes of bytes: 1 for digits, a-z, A-Z and all of non-ASCII, 0 for the rest.
WORD = np.zeros(256, np.uint8)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = 1
#: As WORD, but runs of ASCII punctuation are tokens (class 2) too.
WORD_PUNCT = WORD.copy()
WORD_PUNCT[[b for b in range(0x21, 0x7F) if not WORD[b]]] = 2
#: As WORD, but digits separate.
LETTERS = WORD.copy()
LETTERS[0x30:0x3A] = 0

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers = np.ones(1, U)
_inverses = np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept for the next call up to a few megabytes."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE, U), np.full(size, INVERSE, U)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 8 << 20:
            return up[:n], down[:n]
        _powers, _inverses = up, down
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finisher of MurmurHash3)."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


@dataclass
class Tokens:
    """Tokens of a slice of texts, in order; ``doc`` is the place of each one's text."""

    data: np.ndarray
    sums: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    kind: np.ndarray
    n_docs: int
    inverses: np.ndarray

    def hash_ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range; equal bytes, equal hash, wherever they stand."""
        return mix((self.sums[ends] - self.sums[starts]) * self.inverses[starts] + (ends - starts).astype(U))

    def hashes(self) -> np.ndarray:
        return self.hash_ranges(self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null as empty) and the n + 1 places where they begin and end."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, at - at[0]


def tokenize(texts: pa.Array, classes: np.ndarray = WORD) -> Tokens:
    data, at = buffers(texts)
    n = len(data)
    low = LOWER[data]
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((low.astype(U) + U(1)) * up[:n], out=sums[1:])
    kind = classes[data]
    edge = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[at] = True
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    doc = np.searchsorted(at, starts, "right") - 1
    return Tokens(low, sums, starts, ends, doc, kind[starts], len(texts), down)


def shingles(tokens: Tokens, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: (text's place, 52-bit hash, occurrences), sorted by text, then hash.

    A text of fewer than ``size`` words, but some, has one shingle of all of them.
    """
    h, doc = tokens.hashes(), tokens.doc
    factor = [U((2 * i + 1) * 0xD6E8FEB86659FD93 % 2**64) for i in range(size)]
    n = max(0, len(h) - size + 1)
    grams = np.zeros(n, U)
    for i in range(size):
        grams += h[i : i + n] * factor[i]
    whole = doc[:n] == doc[size - 1 :] if n else np.zeros(0, bool)
    counts = tokens.counts()
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    few = np.zeros(len(short), U)
    for i in range(size - 1):
        has = counts[short] > i
        few[has] += h[first[short[has]] + i] * factor[i]
    grams = mix(np.concatenate([grams[whole], few + U(1)]))
    place = np.concatenate([doc[:n][whole], short]).astype(U)
    keys = np.sort(place << U(52) | grams >> U(12))
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return (keys >> U(52)).astype(np.int64), keys & U((1 << 52) - 1), times


def pieces(tokens: Tokens, which: np.ndarray, sizes: tuple[int, ...], edges: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams inside the tokens ``which``: (place in ``which``, 64-bit hash).

    With ``edges`` a gram at a token's start or end differs from the same bytes inside.
    """
    starts, lengths = tokens.starts[which], (tokens.ends - tokens.starts)[which]
    owners, hashes = [], []
    for size in sizes:
        n = np.maximum(lengths - size + 1, 0)
        owner = np.repeat(np.arange(len(which)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        begin = starts[owner] + step
        h = tokens.hash_ranges(begin, begin + size)
        if edges:
            h = h + (step == 0) * U(0xA24BAED4963EE407) + (step == n[owner] - 1) * U(0x9FB21C651E98DF25)
        owners.append(owner)
        hashes.append(h)
    return np.concatenate(owners), mix(np.concatenate(hashes))
