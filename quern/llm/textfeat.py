"""Vectorised text features: word and n-gram hashes of whole Arrow batches, without a Python loop over words.

A word is a run of ASCII letters, ASCII digits and bytes from 0x80 up (so accented letters belong to words);
case is folded for ASCII and for the Latin-1 capitals. Texts longer than SEGMENT bytes are hashed in segments
that end between words; a single run longer than that is cut at multiples of SEGMENT, alike wherever it occurs.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))
_POW: dict[str, tuple[np.ndarray, np.ndarray]] = {}

_WORD = np.zeros(256, bool)
_WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _P and of its inverse, at least; one table is kept, as every worker of an executor has its own."""
    if "all" not in _POW or len(_POW["all"][0]) < n:
        size = -(-n // (1 << 16)) * (1 << 16)
        a = np.full(size, _P, np.uint64)
        b = np.full(size, _PI, np.uint64)
        a[0] = b[0] = 1
        _POW["all"] = (np.cumprod(a), np.cumprod(b))
    return _POW["all"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fold_case(raw: np.ndarray) -> np.ndarray:
    low = _LOWER[raw]
    if len(raw) > 1:
        cap = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low[1:][cap] += 32
    return low


def _segment(raw: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...]):
    low = _fold_case(raw)
    w = _WORD[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = w
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    before[edge] = False
    s = np.flatnonzero(w & ~before[:-1])
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = w
    after[edge] = False
    e = np.flatnonzero(w & ~after[1:]) + 1
    p, pi = _powers(len(raw) + 1)
    c = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=c[1:])
    base, inv = c[s], pi[s]
    h = mix((c[e] - base) * inv)
    more = [mix((c[np.minimum(s + k, e)] - base) * inv + np.uint64(0xA5A5 * k + 1)) for k in prefixes]
    return s, e, h, more


def words(raw: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()):
    """start, end (bytes in raw), hash of each word, hashes of its first k bytes for each k, and words before each text (len(offsets))."""
    n = len(raw)
    parts, at = [], 0
    while at < n:
        stop = min(n, at + SEGMENT)
        if stop < n:
            # End at a text's start if one lies inside; a longer text is cut between words, counted from its own start.
            k = int(np.searchsorted(offsets, stop, "right")) - 1
            if offsets[k] > at:
                stop = int(offsets[k])
            else:
                gap = np.flatnonzero(~_WORD[raw[at:stop]])
                stop = at + int(gap[-1]) + 1 if len(gap) else stop
        o = offsets[(offsets >= at) & (offsets <= stop)] - at
        s, e, h, more = _segment(raw[at:stop], o, prefixes)
        parts.append((s + at, e + at, h, more))
        at = stop
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), [np.zeros(0, np.uint64) for _ in prefixes], np.zeros(len(offsets), np.int64)
    s, e, h = (np.concatenate([p[i] for p in parts]) for i in range(3))
    more = [np.concatenate([p[3][i] for p in parts]) for i in range(len(prefixes))]
    return s, e, h, more, np.searchsorted(s, offsets, "left")


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams inside each text, and n-grams before each text. Texts of fewer words have one of all their words."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if not len(h):
        return h, np.zeros(len(first), np.int64)
    g = np.zeros(len(h), np.uint64)
    last = first[1:][doc] - 1
    here = np.arange(len(h))
    for k in range(n):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[np.minimum(here + k, last)]
    keep = (here + n - 1 <= last) | (here == first[:-1][doc])
    g, doc = mix(g)[keep], doc[keep]
    return g, np.searchsorted(doc, np.arange(len(first)), "left")
