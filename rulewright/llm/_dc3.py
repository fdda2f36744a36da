"""Difference-cover suffix sorting (modulo 3) of byte strings, vectorised."""

from __future__ import annotations

import numpy as np


def _names(t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks (from 1) of the triples of t at the given positions; behind the end t is 0."""
    padded = np.concatenate([t, np.zeros(3, dtype=np.int64)])
    bits = max(1, int(t.max(initial=0)).bit_length())
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    if 3 * bits <= 63:
        _, names = np.unique((a << (2 * bits)) | (b << bits) | c, return_inverse=True)
    else:
        order = np.lexsort((c, b, a))
        new = np.ones(len(at), dtype=np.int64)
        x, y, z = a[order], b[order], c[order]
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
        names = np.empty(len(at), dtype=np.int64)
        names[order] = np.cumsum(new) - 1
    return names.astype(np.int64) + 1, int(names.max(initial=-1)) + 1


def _pair(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    return a * (size + 1) + b


def suffix_order(t: np.ndarray, depth: int, cover: int = 1) -> np.ndarray:
    """Positions of t ordered by their suffixes, exact for at least the first `depth` bytes where a symbol stands for `cover` bytes.

    The triples at positions 1 and 2 modulo 3 are sorted and named; if names repeat, the string of names is sorted by
    recursion (its symbols cover three times as many bytes, so it ends once they cover depth); the positions 0 modulo 3
    are sorted by their first symbol and the rank behind it, and merged. t holds positive integers.
    """
    n = len(t)
    t = t.astype(np.int64)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), dtype=np.int64)
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    names, distinct = _names(t, sample)
    if distinct < len(sample) and 3 * cover < depth:
        # A zero between the halves keeps suffixes of the first from running into the second.
        text = np.concatenate([names[: len(one)], [0], names[len(one) :]]) + 1
        order = suffix_order(text, depth, 3 * cover)
        rank_of = np.empty(len(text), dtype=np.int64)
        rank_of[order] = np.arange(1, len(text) + 1)
        names = np.delete(rank_of, len(one))
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample] = names
    size = int(names.max(initial=0)) + 1
    symbols = np.concatenate([t, np.zeros(3, dtype=np.int64)])
    sorted_sample = sample[np.argsort(names, kind="stable")]
    by_zero = zero[np.argsort(_pair(symbols[zero], rank[zero + 1], size), kind="stable")]
    # How many positions of each kind of the sample stand before each position 0 modulo 3.
    firsts = sorted_sample[sorted_sample % 3 == 1]
    seconds = sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(_pair(symbols[firsts], rank[firsts + 1], size), _pair(symbols[by_zero], rank[by_zero + 1], size))
    top = int(t.max()) + 1
    two_of = lambda i: _pair(symbols[i] * top + symbols[i + 1], rank[i + 2], size)
    if top * top * (size + 1) < 1 << 62:
        before = before + np.searchsorted(two_of(seconds), two_of(by_zero))
    else:
        _, both = np.unique(np.concatenate([symbols[seconds] * top + symbols[seconds + 1], symbols[by_zero] * top + symbols[by_zero + 1]]), return_inverse=True)
        k = len(seconds)
        before = before + np.searchsorted(_pair(both[:k], rank[seconds + 2], size), _pair(both[k:], rank[by_zero + 2], size))
    place = np.maximum.accumulate(before) + np.arange(len(by_zero))
    out = np.empty(n, dtype=np.int64)
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[place], out[free] = by_zero, sorted_sample
    return out
