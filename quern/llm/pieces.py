"""N-best segmentation of whole texts into the pieces of a SentencePiece model, and decoding.

A text's lattice has an edge for each piece at each place. No piece has a space (as U+2581) after another character,
and some characters are in no piece but their own, so the lattice falls into units: spaces with the characters after
them, and such single characters. The best and the second-best score of all new units of a batch come from vectorised
forward and backward Viterbi passes (every path but the best has an edge that the best has not; the best path through
an edge scores forward + edge + backward). The n best segmentations of a text differ from the best only within the
n - 1 units with the least loss of their second-best, so only those go through the search: backward A* from the unit's
end, whose heuristic is the forward Viterbi score of the place reached, which is exact; paths end in order of score.
The units' lists are then merged by a heap in order of score. Nothing is pruned: the result is that of a search over
the whole text's lattice.

A character without a piece of its own is an edge of the least piece score less 10, and is written as its bytes. The
text isn't normalised; a space goes before it, as the model asks.

Defined results: null and empty texts have one segmentation without ids, of score 0; a text of fewer than n
segmentations has as many rows as it has segmentations; of equal scores those come first that the search meets first,
an order fixed by the text; an empty table gives no rows; other columns aren't read; rows of one
doc_id are separate. U+2581 in a text decodes as a space.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ragged, ship, text_buffer
from .quality import plain
from .textfeat import _powers

SPACE = "▁"
#: Longer units, and those with a character beyond all pieces, go through the lattice one by one.
LONG = 64
_NONE = -np.inf


class Segmenter:
    def __init__(self, path: str, remember: int = 400_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        self.text = [b""] * self.size
        self.byte = [0] * 256
        self.piece: dict[str, tuple[int, float]] = {}
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.text[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.piece[p] = (i, sp.get_score(i))
                self.text[i] = p.replace(SPACE, " ").encode()
        if any(SPACE in p.lstrip(SPACE) for p in self.piece):
            raise ValueError("a piece has a space after another character")
        self.longest = max(map(len, self.piece))
        self.unknown = min(s for _, s in self.piece.values()) - 10
        joined = {c for p in self.piece if len(p) > 1 for c in p}
        self.single = {c for c in self.piece if len(c) == 1}
        alone = "".join(re.escape(c) for c in sorted(map(chr, [*range(128)])) if c not in joined and c != " ")
        alone_class = f"[{alone}]|" if alone else ""
        rest = f"[^ {SPACE}{alone}]+"
        self.units = re.compile(f"{alone_class}[ {SPACE}]*{rest}|[ {SPACE}]+")
        names = sorted(self.piece)
        cp = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in names]
        p, _ = _powers(self.longest + 1)
        with np.errstate(over="ignore"):
            key = np.array([((c.astype(np.uint64) + np.uint64(1)) * p[: len(c)]).sum(dtype=np.uint64) for c in cp], np.uint64)
        o = np.argsort(key)
        if len(np.unique(key)) < len(key):
            raise ValueError("two pieces have one hash")
        self.keys = key[o]
        self.key_id = np.array([self.piece[names[i]][0] for i in o], np.int32)
        self.key_score = np.array([self.piece[names[i]][1] for i in o], np.float64)
        self.map = np.zeros(1 << 20, bool)
        self.map[self.keys >> np.uint64(44)] = True
        self.remember = remember
        self.lists: dict[tuple[str, int], list] = {}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.count = self.used = 0
        self.score, self.gap = np.zeros(1024), np.zeros(1024)
        self.at, self.len = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool = np.zeros(1 << 14, np.uint32)
        self.lists.clear()

    # one unit

    def lattice(self, unit: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """Edges by their end (start, score, ids) and the forward scores."""
        n, piece = len(unit), self.piece
        ends: list[list] = [[] for _ in range(n + 1)]
        fwd = [0.0] + [_NONE] * n
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                if (x := piece.get(unit[s:e])) is not None:
                    ends[e].append((s, x[1], (x[0],)))
            if unit[e - 1] not in self.single:
                ends[e].append((e - 1, self.unknown, tuple(self.byte[b] for b in unit[e - 1].encode())))
            fwd[e] = max((fwd[s] + w for s, w, _ in ends[e]), default=_NONE)
        return ends, fwd

    def nbest(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a unit by score: backward A* over its lattice.

        Of equal estimates the newest is followed first, so that a run of one character, with its endless ties, is
        gone through in depth.
        """
        unit = unit.replace(" ", SPACE)
        ends, fwd = self.lattice(unit)
        heap = [(-fwd[-1], 0, len(unit), 0.0, None)]
        made, out = 0, []
        while heap and len(out) < n:
            _, _, at, g, path = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((g, tuple(ids)))
                continue
            for s, w, x in ends[at]:
                made -= 1
                heapq.heappush(heap, (-(fwd[s] + w + g), made, s, w + g, (x, path)))
        return out

    # batches of units

    def _learn(self, units: list[str]) -> None:
        with_space = [u.replace(" ", SPACE) for u in units]
        slow = [i for i, u in enumerate(with_space) if len(u) > LONG or not self.single.issuperset(u)]
        fast = sorted(set(range(len(units))) - set(slow), key=lambda i: -len(with_space[i]))
        for k in range(0, len(fast), 8192):
            some = fast[k : k + 8192]
            self._keep([units[i] for i in some], *self._viterbi([with_space[i] for i in some]))
        for i in slow:
            two = self.nbest(units[i], 2)
            gap = two[0][0] - two[1][0] if len(two) > 1 else np.inf
            self._keep([units[i]], np.array([two[0][0]]), np.array([gap]), np.array(two[0][1], np.uint32), np.array([0, len(two[0][1])]))

    def _keep(self, units: list[str], score: np.ndarray, gap: np.ndarray, ids: np.ndarray, bound: np.ndarray) -> None:
        need, total = self.count + len(units), self.used + len(ids)
        for name in ("score", "gap", "at", "len"):
            a = getattr(self, name)
            if need > len(a):
                setattr(self, name, np.concatenate([a, np.zeros(max(need, 2 * len(a)) - len(a), a.dtype)]))
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, 2 * len(self.pool)) - len(self.pool), np.uint32)])
        c = slice(self.count, need)
        self.score[c], self.gap[c], self.len[c], self.at[c] = score, gap, np.diff(bound), self.used + bound[:-1]
        self.pool[self.used : total] = ids
        self.known.update(zip(units, range(self.count, need)))
        self.count, self.used = need, total

    def _viterbi(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, loss of the second-best, ids of the best and their bounds; units: by length, longest first."""
        cp = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        size = np.array([len(u) for u in units])
        m, t_all = len(units), len(cp)
        off = np.cumsum(size) - size
        left = np.repeat(off + size, size) - np.arange(t_all)  # characters to the unit's end
        p, pi = _powers(t_all + 1)
        c = np.zeros(t_all + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * p[:t_all], out=c[1:])
        most = min(self.longest, int(size[0]))
        score = np.full((most, t_all + 1), _NONE)
        ident = np.zeros((most, t_all + 1), np.int32)
        for k in range(1, most + 1):
            i = np.flatnonzero(left >= k)
            h = (c[i + k] - c[i]) * pi[i]
            maybe = self.map[h >> np.uint64(44)]
            i, h = i[maybe], h[maybe]
            j = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            ok = self.keys[j] == h
            score[k - 1, i[ok]], ident[k - 1, i[ok]] = self.key_score[j[ok]], self.key_id[j[ok]]
        node = off + np.arange(m)  # each unit has a node more than it has characters
        fwd = np.full(t_all + m + most + 1, _NONE)
        arg = np.zeros(t_all + m, np.int64)
        fwd[node] = 0
        active = [int(np.searchsorted(-size, -t, "right")) for t in range(int(size[0]) + 1)]
        for t in range(1, int(size[0]) + 1):
            a = active[t]
            best, which = np.full(a, _NONE), np.zeros(a, np.int64)
            at, char = node[:a] + t, off[:a] + t
            for k in range(1, min(most, t) + 1):
                v = fwd.take(at - k)
                v += score[k - 1].take(char - k)
                np.copyto(which, k, where=v > best)
                np.maximum(best, v, out=best)
            fwd[at], arg[at] = best, which
        bwd = np.full(t_all + m + most + 1, _NONE)
        bwd[node + size] = 0
        for t in range(int(size[0]) - 1, -1, -1):
            a = active[t + 1]
            best = np.full(a, _NONE)
            at, char = node[:a] + t, off[:a] + t
            for k in range(1, min(most, int(size[0]) - t) + 1):
                v = bwd.take(at + k)
                v += score[k - 1].take(char)
                np.maximum(best, v, out=best)
            bwd[at] = best
        total = fwd[node + size]
        # the best path, from the end
        cur, steps, on_path = size.copy(), [], np.zeros((most, t_all), bool)
        while (live := np.flatnonzero(cur)).size:
            k = arg[node[live] + cur[live]]
            at = off[live] + cur[live] - k
            on_path[k - 1, at] = True
            steps.append((live, ident[k - 1, at]))
            cur[live] -= k
        second = np.full(t_all, _NONE)
        here = np.arange(t_all) + np.repeat(np.arange(m), size)
        start = fwd.take(here)
        for k in range(1, most + 1):
            v = start + score[k - 1, :t_all]
            v += bwd.take(here + k)
            v[on_path[k - 1]] = _NONE
            np.maximum(second, v, out=second)
        gap = total - np.maximum.reduceat(second, off)
        n_ids = np.bincount(np.concatenate([s[0] for s in steps]), minlength=m)
        bound = np.concatenate([[0], np.cumsum(n_ids)])
        ids = np.zeros(bound[-1], np.uint32)
        seen = bound[1:].copy()
        for live, x in steps:
            seen[live] -= 1
            ids[seen[live]] = x
        return total, gap, ids, bound

    # texts

    def encode(self, text: str, n: int) -> list[tuple[float, np.ndarray, bool]]:
        """The n best segmentations of a text: score, ids and whether they decode to it."""
        return next(iter(self.encode_batch([text], n)))

    def encode_batch(self, texts: list[str | None], n: int) -> Iterator[list[tuple[float, np.ndarray, bool]]]:
        found = [self.units.findall(" " + t) if t else [] for t in texts]
        if self.count > self.remember:
            self._forget()
        missing = set().union(*found).difference(self.known)
        if missing:
            self._learn(sorted(missing))
        for units, text in zip(found, texts):
            if not units:
                yield [(0.0, np.zeros(0, np.uint32), True)]
                continue
            ix = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
            size, gap = self.len[ix], self.gap[ix]
            ids = self.pool[ragged(self.at[ix], size)]
            score = float(self.score[ix].sum())
            same = self.decode(ids) == text.replace(SPACE, " ")
            out = [(score, ids, same)]
            if n > 1:
                o = np.argsort(gap, kind="stable")[: n - 1] if len(gap) <= 4 * n else self._least(gap, n - 1)
                places = np.sort(o[np.isfinite(gap[o])])
                ends = np.cumsum(size)
                for loss, change in self._combine([units[i] for i in places], n)[1:]:
                    parts, done, right = [], 0, same
                    for k, new, kept in change:
                        i, right = places[k], right and kept
                        parts += [ids[done : ends[i] - size[i]], new]
                        done = ends[i]
                    out.append((score - loss, np.concatenate([*parts, ids[done:]]), right))
            yield out

    @staticmethod
    def _least(gap: np.ndarray, k: int) -> np.ndarray:
        """The places of the k least, the first of equals."""
        bound = np.partition(gap, k - 1)[k - 1]
        few = np.flatnonzero(gap <= bound)
        return few[np.argsort(gap[few], kind="stable")][:k]

    def _combine(self, units: list[str], n: int) -> list[tuple[float, list[tuple[int, np.ndarray, bool]]]]:
        """The n least losses over choices from the units' lists, with the ids that differ from the best and whether they decode alike."""
        lists = []
        for u in units:
            if (u, n) not in self.lists:
                found = self.nbest(u, n)
                i = self.known[u]
                best = tuple(self.pool[self.at[i] : self.at[i] + self.len[i]].tolist())
                # the best of the passes first: it may be one of several of that score
                found = sorted(found, key=lambda x: (x[1] != best, -x[0], x[1]))
                if found[0][1] != best:
                    found = [(self.score[i], best), *found][:n]
                self.lists[u, n] = [(float(found[0][0] - s), np.array(x, np.uint32), self._bytes(x) == self._bytes(best)) for s, x in found]
            lists.append(self.lists[u, n])
        start = (0,) * len(lists)
        heap, seen, out = [(0.0, start)], {start}, []
        while heap and len(out) < n:
            loss, pick = heapq.heappop(heap)
            out.append((loss, [(k, *lists[k][j][1:]) for k, j in enumerate(pick) if j]))
            for k, j in enumerate(pick):
                if j + 1 < len(lists[k]):
                    new = (*pick[:k], j + 1, *pick[k + 1 :])
                    if new not in seen:
                        seen.add(new)
                        heapq.heappush(heap, (sum(lists[q][r][0] for q, r in enumerate(new)), new))
        return out

    def _bytes(self, ids) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        raw = self._bytes(ids.tolist())
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


_SEGMENTERS: dict[str, Segmenter] = {}


def segmenter(path: str) -> Segmenter:
    """One per Python worker and model."""
    if path not in _SEGMENTERS:
        _SEGMENTERS[path] = Segmenter(path)
    return _SEGMENTERS[path]


def encode(docs: DataFrame, model: str, n: int = 4, with_ids: bool = True) -> DataFrame:
    """doc_id, rank (from 1), score, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32 bits), round_trip (whether they decode to the text) and, if asked for, ids (binary)."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = segmenter(model)
        for b in chunks(batches, "text"):
            out = []
            for doc, best in zip(b.column("doc_id").to_pylist(), s.encode_batch(b.column("text").to_pylist(), n)):
                for k, (score, ids, same) in enumerate(best):
                    raw = ids.tobytes()
                    out.append((doc, k + 1, score, len(ids), zlib.crc32(raw), same, *[raw] * with_ids))
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()] + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "rank", "score", "n_tokens", "ids_crc32", "round_trip", *["ids"] * with_ids])

    return plain(docs).mapInArrow(rows, "doc_id long, rank int, score double, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids binary" * with_ids)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (binary, little-endian unsigned 32 bits; null: null)."""
    ship(rows.sparkSession)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = segmenter(model)
        for b in batches:
            out = [None if x is None else s.decode(np.frombuffer(x, np.uint32)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(texts, "doc_id long, text string")
