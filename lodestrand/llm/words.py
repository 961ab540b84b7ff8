"""Words of many texts at once: where they are and 64-bit hashes of them."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Space and the controls from tab to carriage return part words (fixed values).
SEPARATORS = [0x20, *range(0x09, 0x0E)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, each to one other."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


#: Spans of more bytes are hashed one by one.
LONG = 128
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of b on as one number; zeros follow the end."""
    held = np.concatenate([b, np.zeros(8, np.uint8)])
    return np.ndarray((len(b) + 1,), "<u8", held, strides=(1,))


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each b[start:end] that depends on its bytes alone.

    Eight bytes at a time are mixed in, with a full mix between them: unlike a
    polynomial modulo 2**64 it has no family of texts that always meet. Spans
    of more than LONG bytes are hashed by BLAKE2.
    """
    size, lanes = ends - starts, eights(b)
    h = mixed(size.astype(U) + U(BASE))
    live, k = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - k
        h[live] = mixed(h[live] ^ (lanes[starts[live] + k] & _MASK[np.minimum(left, 8)]))
        live, k = live[left > 8], k + 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[SEPARATORS] = False


def find_words(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in b; none runs over from text to text."""
    w = _IS_WORD[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[offsets] = True
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1] | edge[1:-1]
    end[:-1] &= ~w[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with A-Z lower-cased, and the number of words before each text and in all."""
    starts, ends = find_words(b, offsets)
    return span_hashes(_LOWER[b], starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text and where each text's begin.

    first: where each text's words begin, and the end. A text with fewer than
    n words (but one at least) has one shingle: its whole word sequence.
    """
    count = np.diff(first)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(bounds[-1], U)
    if len(hashes) >= n:
        rolled = np.full(len(hashes) - n + 1, n, U) * U(BASE)
        for k in range(n):
            rolled = mixed(rolled * U(BASE) + hashes[k : len(hashes) - n + 1 + k])
        doc = np.repeat(np.arange(len(count)), np.where(count >= n, per, 0))
        long_bounds = np.concatenate([[0], np.cumsum(np.where(count >= n, per, 0))])
        inner = np.arange(len(doc)) - long_bounds[doc]
        out[bounds[doc] + inner] = rolled[first[doc] + inner]
    for i in np.flatnonzero((count > 0) & (count < n)).tolist():
        h = np.array([count[i]], U) * U(BASE)
        for x in hashes[first[i] : first[i + 1]]:
            h = mixed(h * U(BASE) + x)
        out[bounds[i]] = h[0]
    return out, bounds
