"""Exact encoding by the `tokenizers` library, made fast by remembering the ids of each distinct piece.

The vocabulary `word_bpe_49k.json` normalises (NFC, white space, lower case), splits by a pattern none of whose
matches holds white space, and merges inside each match alone. So a text's ids are those of its matches, one after
another, and a match that was seen before need not be merged again. Texts with characters whose folding or class
isn't settled by the simple table below are cut at ASCII white space instead, and each part goes through the whole
tokenizer. Both ways return what `encode(text, add_special_tokens=False)` does.
"""

from __future__ import annotations

import re

import numpy as np

from .common import ragged
from .textfeat import _fold_case, _powers

LETTERS = "a-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^ \\t\\n\\r{LETTERS}{NUMBERS}]+")
#: Control white space, NEL, NBSP, dotted capital I and all from U+0250 up; special tokens' strings.
UNUSUAL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0İɐ-\U0010ffff]|<\\|")
SPACES = re.compile(r"[ \t\n\r]+")
#: Pieces longer than this aren't remembered.
LONG = 64
_ODD = np.zeros(256, bool)
_ODD[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, *range(0xC4, 0x100)]] = True
#: 0 white space, 1 letter, 2 digit, 3 other
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


class Encoder:
    """ids(text) gives the ids as little-endian unsigned 32-bit bytes. `remember` bounds the cache only."""

    def __init__(self, path: str, remember: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers import pre_tokenizers as pt

        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pt.Sequence([pt.WhitespaceSplit(), pt.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.whole.get_vocab_size()
        self.ends = np.zeros(size + 1, bool)
        for token, i in self.whole.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        self.remember = remember
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        new: dict[str, bytes] = {}
        for k in range(0, len(pieces), 512):
            some = pieces[k : k + 512]
            ids = np.array(self.merges.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some):
                raw, at = ids.tobytes(), 0
                for p, c in zip(some, (cut * 4).tolist()):
                    new[p] = raw[at:c]
                    at = c
            else:  # a piece whose last byte has no ending token: one by one
                for p in some:
                    new[p] = np.array(self.merges.encode(p, add_special_tokens=False).ids, np.uint32).tobytes()
        return new

    def _fast(self, texts: list[str]) -> list[bytes]:
        found = [PIECES.findall(t.lower()) for t in texts]
        cache = self.cache
        if len(cache) > self.remember:
            cache.clear()
        missing = set()
        for f in found:
            missing.update(f)
        missing.difference_update(cache)
        if missing:
            cache.update(self._learn(list(missing)))
        out = [b"".join(map(cache.__getitem__, f)) for f in found]
        for p in missing:
            if len(p) > LONG:
                del cache[p]
        return out

    def _slow(self, text: str) -> bytes:
        parts = SPACES.split(text)
        if len(self.parts) > self.remember // 4:
            self.parts.clear()
        missing = list({p for p in parts if p not in self.parts})
        for p, e in zip(missing, self.whole.encode_batch_fast(missing, add_special_tokens=False)):
            self.parts[p] = np.array(e.ids, np.uint32).tobytes()
        out = b"".join(map(self.parts.__getitem__, parts))
        for p in missing:
            if len(p) > LONG:
                del self.parts[p]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        for i, t in enumerate(texts):
            if t:
                if UNUSUAL.search(t):
                    out[i] = self._slow(t)
                else:
                    plain.append(i)
        for i, x in zip(plain, self._fast([texts[i] for i in plain])):
            out[i] = x
        return out

    def _add(self, keys: np.ndarray, pieces: list[str]) -> None:
        known = self._learn(pieces)
        new = [np.frombuffer(known[p], np.uint32) for p in pieces]
        size = np.array([len(x) for x in new], np.int64)
        flat = np.concatenate(new)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.at, self.size = (np.concatenate(x)[order] for x in ((self.keys, keys), (self.at, at), (self.size, size)))

    def encode_batch(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a buffer, one after another, and the number of each."""
        n, docs = len(raw), len(off) - 1
        if not n:
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        low, cls = _fold_case(raw), _CLASS[raw]
        odd = _ODD[raw]
        odd[:-1] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)) | (raw[:-1] == 60) & (raw[1:] == 124)
        b = np.ones(n + 1, bool)
        b[1:n] = (cls[1:] != cls[:-1]) | (cls[1:] == 2)
        b[off[off < n]] = True
        q = np.flatnonzero((raw == 39) & b[:-1] & b[1:])
        q = q[q + 1 < n]
        q = q[(cls[q + 1] == 1) & ~np.isin(q + 1, off)] if len(q) else q
        if len(q):
            end = np.searchsorted(off, q, "right")
            one = np.isin(low[q + 1], np.frombuffer(b"stmd", np.uint8))
            x, y = low[q + 1], low[np.minimum(q + 2, n - 1)]
            two = ((x == 114) & (y == 101) | (x == 118) & (y == 101) | (x == 108) & (y == 108)) & (q + 2 < off[end]) & ~one
            b[q[one | two] + 1] = False
            b[q[one] + 2] = True
            b[q[two] + 3] = True
        cut = np.flatnonzero(b)
        s, e = cut[:-1], cut[1:]
        keep = cls[s] != 0
        s, e = s[keep], e[keep]
        bad = np.zeros(docs, bool)
        bad[np.searchsorted(off, np.flatnonzero(odd), "right") - 1] = True
        bad[np.searchsorted(off, s[e - s > LONG], "right") - 1] = True
        doc = np.searchsorted(off, s, "right") - 1
        if bad.any():
            keep = ~bad[doc]
            s, e, doc = s[keep], e[keep], doc[keep]
        counts = np.zeros(docs, np.int64)
        ids = np.zeros(0, np.uint32)
        if len(s):
            p, pi = _powers(n + 1)
            c = np.zeros(n + 1, np.uint64)
            np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[:n], out=c[1:])
            key, first, inverse = np.unique((c[e] - c[s]) * pi[s], return_index=True, return_inverse=True)
            k = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            missing = self.keys[k] != key if len(self.keys) else np.ones(len(key), bool)
            if missing.any():
                if len(self.keys) + missing.sum() > self.remember:
                    self._forget()
                    missing[:] = True
                i, whole = first[missing], low.tobytes()
                self._add(key[missing], [whole[x:y].decode() for x, y in zip(s[i].tolist(), e[i].tolist())])
                k = np.searchsorted(self.keys, key)
            size = self.size[k][inverse]
            ids = self.pool[ragged(self.at[k][inverse], size)]
            counts = np.bincount(doc, size, docs).astype(np.int64)
        if bad.any():
            texts = [raw[off[i] : off[i + 1]].tobytes().decode() for i in np.flatnonzero(bad)]
            others = dict(zip(np.flatnonzero(bad).tolist(), self.encode(texts)))
            ends = np.cumsum(counts)
            parts, done = [], 0
            for i, x in others.items():
                parts += [ids[done : ends[i]], np.frombuffer(x, np.uint32)]
                done = int(ends[i])
                counts[i] = len(x) // 4
            ids = np.concatenate([*parts, ids[done:]])
        return ids, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
