"""Words and word shingles of UTF-8 buffers as 64-bit hashes, without a Python loop a word."""

from __future__ import annotations

import numpy as np

from pagequarry.llm.common import CACHES, mix64

_SEED = np.random.default_rng(20240229)
#: Random values of the 256 bytes and an odd base: a word's hash is a sum of value * base^place.
_VALUES = _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_SEED.integers(1 << 60, 1 << 62)) * 8 + 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {}
CACHES.append(_POWERS.clear)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:  # doubling: the next block is the first one times base^done
            more = min(done, size - done)
            have[done : done + more] = have[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        _POWERS[base] = have
    return have[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many each text has.

    ``offsets`` bound the texts in ``data``; a word is a run of bytes other than
    0x20 and 0x09-0x0D, and never crosses from one text to the next.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    word = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * _powers(_BASE, n), out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``size`` words, and how many each text has.

    A text with fewer words has one shingle, of all its words; one without words has none.
    """
    firsts = np.cumsum(counts) - counts
    total = len(words)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    if not total:
        return np.zeros(0, np.uint64), many
    with np.errstate(over="ignore"):
        rolled = np.zeros(total, np.uint64)
        for k in range(min(size, total)):
            rolled[: total - k] += words[k:] * np.uint64(2 * (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) + 1)
        rolled = mix64(rolled)
        index = np.repeat(firsts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        out = rolled[index]
        at = np.cumsum(many) - many
        for i in np.flatnonzero((counts > 0) & (counts < size)).tolist():
            h = np.uint64(0)
            for k in range(int(counts[i])):
                h += words[firsts[i] + k] * np.uint64(2 * (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) + 1)
            out[at[i]] = mix64(np.array([h + np.uint64(counts[i])], np.uint64))[0]
    return out, many


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """Yield each text's distinct shingle hashes, ascending. A-Z count as a-z."""
    data = LOWER[data]
    starts, ends, counts = word_spans(data, offsets)
    shingles, many = shingle_hashes(word_hashes(data, starts, ends), counts, size)
    at = 0
    for n in many.tolist():
        if n > 1:
            one = np.sort(shingles[at : at + n])
            keep = np.empty(n, bool)
            keep[0] = True
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            yield one[keep]
        else:
            yield shingles[at : at + n].copy()
        at += n
