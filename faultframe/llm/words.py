"""Words and word shingles of many texts at once, as arrays.

A word is a run of bytes outside [\\x20\\x09-\\x0D] with A-Z lower-cased; it and its shingles are known by 64-bit hashes.
"""

import numpy as np

SHINGLE = 5

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
# Everything in ASCII but letters and digits: words between these do not depend on punctuation.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that all their bits can be used."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_PLACES = mix(np.arange(1001, 1001 + 64, dtype=np.uint64) * _BASE) | np.uint64(1)


def spans(data: np.ndarray, offsets: np.ndarray, between=_SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (one more entry at the end)."""
    solid = ~between[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begins[heads] = solid[heads]
    ends[tails] = solid[tails]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower=True) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges are in order and do not overlap."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(firsts, lengths)
    taken = data[place + np.repeat(starts, lengths)]
    powers = np.full(int(lengths.max()), _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    terms = (_VALUES[_LOWER] if lower else _VALUES)[taken] * powers[place]
    return mix(np.add.reduceat(terms, firsts) + lengths.astype(np.uint64) * _BASE)


def word_hashes(data: np.ndarray, offsets: np.ndarray, between=_SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the index of each text's first word (one more entry at the end)."""
    starts, ends, first = spans(data, offsets, between)
    return hashes(data, starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray, size=SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a text, in order; fewer words count as one run, none as no run.

    Also the index of each text's first shingle (one more entry at the end).
    """
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(first[:-1] - begin[:-1], made) + np.arange(begin[-1])
    total = np.zeros(len(at), dtype=np.uint64)
    short = np.repeat(counts < size, made)
    left = np.repeat(counts, made)
    whole = not short.any()
    for k in range(size):
        if whole:
            total += words[at + k] * _PLACES[k]
        else:
            use = ~short | (k < left)
            total[use] += words[at[use] + k] * _PLACES[k]
    return mix(total + np.where(short, left, size).astype(np.uint64)), begin
