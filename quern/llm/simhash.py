"""Near-duplicates by SimHash and an LSH forest.

Rows of equal texts are one text from the start; everything else is keyed by text, whatever its doc_ids. Two texts are
linked if the Jaccard index of their distinct word pairs (32-bit hashes, of the whole texts) is at least `least`.

Texts are first gathered into balls around a centre at a distance (1 - index) of at most half the threshold, so that
all texts of a ball are linked and needn't be paired, however many they are. Candidates are pairs of balls. The forest
has several tries over the 128 SimHash bits of the centres (of words of over 4 bytes, or all words where a text has
fewer than 8 such), each in another random order: a node of a short prefix goes to one task, which goes down to longer
prefixes where many share the node and stops where few are left; pairs within a node at most `far` bits apart are
candidates. Linked texts may be further apart than that, and more so where few share a node: bands of minima of hashed
word pairs are further nodes, all of whose pairs are candidates, whatever their distance. There are so many that a pair
of index `least` shares one with the chance `recall`, for any number of texts. Short texts share whole lines that are
common, so that such nodes would hold nearly all pairs of them; pairs of which one has at most SHORT word pairs come
from a prefix filter instead, which misses none: with word pairs ordered from rare to frequent, linked texts share one
in the first half of each, and no more after it than what is left of either. The candidates are then held against the
true links of sampled texts, found by brute force over all texts; while fewer than `target` of them are candidates, the
forest climbs to shorter prefixes, at last to its roots, where all are compared.

Candidates whose signatures of 256 bits are further apart than links are (four standard deviations) are left out; the
others are decided by their whole sets of word pairs. Pairs of balls of which all or no members are linked are counted
as a whole, the others text by text, in blocks. So links are counted without a list of them.

Nodes, balls and groups of more than a bounded size are split into blocks, so that no task gets an unbounded group, and
nothing is dropped.

Defined results: a null text counts as empty; texts without words link with equal texts only (empty ones all with each
other); rows of one doc_id count as copies of one document, so their texts are of one class, though linked only if they
are near; rows without doc_id are known by a negative number made from their text; texts of any length count whole; an
empty table gives no rows; other columns aren't read, whatever their names. A run of characters beyond ASCII without a
space is one word, so texts in scripts without spaces link only where whole runs between spaces or ASCII signs agree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ragged, saved, ship, text_buffer
from .components import components
from .textfeat import mix, ngrams, words

BITS = 128
#: Bits of minima by which chance meetings are told.
SIGNATURE = 256
#: Pairs of texts of which one has at most so many word pairs are found by a prefix filter.
SHORT = 64
_LANES = np.zeros((256, 2), np.uint64)
for _b in range(8):
    _LANES[:, _b // 4] |= ((np.arange(256) >> (7 - _b)) & 1).astype(np.uint64) << np.uint64(16 * (_b % 4))


def fingerprints(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the distinct (doc, hash) rows, sorted by doc: two unsigned 64-bit numbers for each of n texts."""
    out = np.zeros((n, 2), np.uint64)
    if not len(h):
        return out
    # lanes of 16 bits hold counts of at most 32,768 words; longer texts are summed in parts
    place = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
    start = np.flatnonzero((place % 32768) == 0)
    owner = doc[start]
    total = np.bincount(doc, minlength=n)
    for w in range(2):
        y = mix(h + np.uint64(w * 7919 + 1))
        sums = np.add.reduceat(_LANES[y.view(np.uint8).reshape(-1, 8)].reshape(len(h), 16), start, axis=0).view(np.uint16).reshape(-1, 64)
        if len(start) == len(np.unique(owner)):
            counts = np.zeros((n, 64), np.int64)
            counts[owner] = sums
        else:
            counts = np.zeros((n, 64), np.int64)
            np.add.at(counts, owner, sums.astype(np.int64))
        out[:, w] = np.packbits(counts * 2 > total[:, None], axis=1).view(np.uint64).ravel()
    return out


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.lexsort((h, doc))
    d, x = doc[o], h[o]
    k = np.ones(len(d), bool)
    k[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return d[k], x[k]


@dataclass(frozen=True)
class Bands:
    """How many bands of how many minima each: a pair of Jaccard index `least` shares one with the chance `recall`."""

    count: int
    size: int

    @classmethod
    def of(cls, rows: int, least: float, recall: float) -> Bands:
        """Longer bands, and more of them, for larger tables, so that chance meetings don't outgrow the rows; the recall stays."""
        size = 4 if rows <= 10**7 else 5 if rows <= 10**9 else 6
        one = least**size
        return cls(1 if one >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - one))), size)


def minima(low: np.ndarray, at: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's word pairs low[at[k]:at[k + 1]]: (texts, bands) keys of 40 bits, and SIGNATURE bits of minima as (texts, SIGNATURE / 64) numbers."""
    n = len(at) - 1
    keys, bits = np.zeros((n, bands.count), np.int64), np.zeros((n, SIGNATURE), np.uint8)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return keys, np.zeros((n, SIGNATURE // 64), np.int64)
    m = mix(low.astype(np.uint64) + np.uint64(1))
    by = np.random.default_rng(11).integers(1 << 63, size=max(bands.count * bands.size, SIGNATURE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k, a in enumerate(by):
        least = mix(np.minimum.reduceat(m * a, at[some]))
        if k < SIGNATURE:
            bits[some, k] = least >> np.uint64(63)
        if k < bands.count * bands.size:
            keys[some, k // bands.size] = (mix(keys[some, k // bands.size].view(np.uint64) + least) if k % bands.size else least).view(np.int64)
    return (keys.view(np.uint64) >> np.uint64(24)).view(np.int64), np.packbits(bits, axis=1).view(np.int64)


def features(raw: np.ndarray, off: np.ndarray, bands: Bands):
    """Fingerprints, number of words, distinct word pairs (sorted unsigned 32-bit hashes of all texts, and where each text's begin), keys of the bands and signatures."""
    s, e, h, _, first = words(raw, off)
    n = len(off) - 1
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    long = e - s > 4
    few = np.bincount(doc[long], minlength=n) < 8
    use = long | few[doc]
    d, x = _distinct(doc[use], h[use])
    fp = fingerprints(x, d, n)
    g, gf = ngrams(h, first, 2)
    key = np.sort((np.repeat(np.arange(n, dtype=np.uint64), np.diff(gf)) << np.uint64(32)) | (g >> np.uint64(32)))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    at = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return fp, count, low, at, *minima(low, at, bands)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / max(1, len(a) + len(b) - same)


class Sets:
    """Sorted sets of 32-bit numbers, compared many at a time."""

    def __init__(self, sets: list[bytes]):
        self.size = np.array([len(s) // 4 for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(sets), np.uint32)
        self.mark = np.zeros(1 << 20, bool)  # by the upper 20 bits

    def jaccard(self, one: int, others: np.ndarray) -> np.ndarray:
        own = self.flat[self.at[one] : self.at[one + 1]]
        out = np.zeros(len(others))
        if not len(own) or not len(others):
            return out
        self.mark[own >> np.uint32(12)] = True
        size = self.size[others]
        end = np.cumsum(size)
        cut = np.unique(np.searchsorted(end, np.arange(0, end[-1] + 1, 1 << 20)))
        for first, last in zip(cut, np.append(cut[1:], len(others))):
            v = self.flat[ragged(self.at[others[first:last]], size[first:last])]
            k = np.flatnonzero(self.mark[v >> np.uint32(12)])
            k = k[own[np.minimum(np.searchsorted(own, v[k]), len(own) - 1)] == v[k]]
            same = np.bincount(np.searchsorted(np.cumsum(size[first:last]), k, "right"), minlength=last - first)
            out[first:last] = same / (size[first:last] + len(own) - same)
        self.mark[own >> np.uint32(12)] = False
        return out


def bit_orders(tries: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(BITS) for _ in range(tries)])


def prefixes(fp: np.ndarray, orders: np.ndarray, depth: int) -> np.ndarray:
    """(texts, tries) keys: the first `depth` bits in each trie's order."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), 16), axis=1)
    out = np.zeros((len(fp), len(orders)), np.int64)
    for k in range(depth):
        out = (out << 1) | bits[:, orders[:, k]]
    return out


def depth_for(n: int, leaf: int) -> int:
    """The depth at which n texts lie in nodes of about `leaf`."""
    return max(0, math.ceil(math.log2(max(1, n) / leaf)))


def near(left: np.ndarray, right: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs and distances of fingerprints at most `far` bits apart, a block of rows at a time."""
    i_, j_, h_ = [], [], []
    step = max(1, (1 << 21) // max(1, len(right)))
    for k in range(0, len(left), step):
        a = left[k : k + step]
        h = np.bitwise_count(a[:, None, 0] ^ right[None, :, 0]) + np.bitwise_count(a[:, None, 1] ^ right[None, :, 1])
        i, j = np.nonzero(h <= far)
        i_.append(i + k)
        j_.append(j)
        h_.append(h[i, j])
    return np.concatenate(i_), np.concatenate(j_), np.concatenate(h_)


def _walk(fp: np.ndarray, order: np.ndarray, at: int, depth: int, leaf: int, far: int):
    """Pairs within the nodes of one trie below a prefix of `at` bits: going down while many share a node, never below `depth`."""
    bits = None
    todo, out = [(np.arange(len(fp)), at)], []
    while todo:
        ix, k = todo.pop()
        if len(ix) < 2:
            continue
        if len(ix) <= leaf or k >= depth:
            i, j, _ = near(fp[ix], fp[ix], far)
            out.append((ix[i[i < j]], ix[j[i < j]]))
            continue
        if bits is None:
            bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), 16), axis=1)
        one = bits[ix, order[k]] == 1
        todo += [(ix[one], k + 1), (ix[~one], k + 1)]
    return out


_NO_PAIRS = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})


def _pairs_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    if not found:
        return _NO_PAIRS
    x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})[x != y].drop_duplicates()


def _in_tries(orders: np.ndarray, at: int, depth: int, leaf: int, far: int):
    def pairs(d: pd.DataFrame) -> pd.DataFrame:
        """Candidates of all nodes of the tries in a frame of key, side, ball, f0, f1."""
        d = d.sort_values("key", kind="stable")
        key, ball, side = d.key.to_numpy(), d.ball.to_numpy(), d.side.to_numpy()
        fp = np.stack([d.f0.to_numpy(), d.f1.to_numpy()], axis=1).view(np.uint64)
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        res = []
        for a, z in zip(cut[:-1], cut[1:]):
            if z - a < 2:
                continue
            f, b, s = fp[a:z], ball[a:z], side[a:z]
            if s[0] == 0:
                res += [(b[i], b[j]) for i, j in _walk(f, orders[int(key[a]) >> 40], at, depth, leaf, far)]
            else:  # two blocks of a large node
                l, r = np.flatnonzero(s == 1), np.flatnonzero(s == 2)
                i, j, _ = near(f[l], f[r], far)
                res.append((b[l[i]], b[r[j]]))
        return _pairs_of(res)

    return pairs


def _in_bands(least: float):
    def pairs(d: pd.DataFrame) -> pd.DataFrame:
        """Candidates of all bands' nodes in a frame of key, side, ball, few, most: those whose numbers of word pairs allow the index `least`."""
        d = d.sort_values(["key", "ball"], kind="stable")
        key, ball, side = d.key.to_numpy(), d.ball.to_numpy(), d.side.to_numpy()
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (ball[1:] != ball[:-1])]) if len(d) else np.zeros(0, np.int64)
        few, most = (f.reduceat(d[c].to_numpy(), start) if len(start) else start for f, c in ((np.minimum, "few"), (np.maximum, "most")))
        key, ball, side = key[start], ball[start], side[start]
        res, i, step = [], np.arange(len(key)), 0
        while True:
            step += 1
            i = i[i + step < len(key)]
            i = i[key[i] == key[i + step]]
            if not len(i):
                return _pairs_of(res)
            j = i + step
            ok = ((side[i] == 0) | (side[i] != side[j])) & (most[i] >= least * few[j]) & (most[j] >= least * few[i])
            res.append((ball[i[ok]], ball[j[ok]]))
            if sum(len(r[0]) for r in res[-64:]) > 1 << 22:
                p = _pairs_of(res)
                res = [(p.a.to_numpy(), p.b.to_numpy())]

    return pairs


def _in_prefixes(least: float):
    def pairs(d: pd.DataFrame) -> pd.DataFrame:
        """Candidates of all word pairs in a frame of key, side, ball, place, size: those whose rest allows the index `least`."""
        d = d.drop_duplicates(["key", "side", "ball", "place", "size"]).sort_values("key", kind="stable")
        key, ball, side, place, size = (d[c].to_numpy() for c in ("key", "ball", "side", "place", "size"))
        rest = size - place
        res, i, step = [], np.arange(len(key)), 0
        while True:
            step += 1
            i = i[i + step < len(key)]
            i = i[key[i] == key[i + step]]
            if not len(i):
                return _pairs_of(res)
            j = i + step
            ok = np.minimum(rest[i], rest[j]) * (1 + least) >= least * (size[i] + size[j]) - 1e-9
            ok &= ((side[i] == 0) | (side[i] != side[j])) & (ball[i] != ball[j])
            res.append((ball[i[ok]], ball[j[ok]]))
            if sum(len(r[0]) for r in res[-64:]) > 1 << 22:
                p = _pairs_of(res)
                res = [(p.a.to_numpy(), p.b.to_numpy())]

    return pairs


def _flat(low: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word pairs of all texts, and how many each has."""
    raw = low.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint32), np.array([len(x) // 4 for x in raw], np.int64)


def _short(rows: DataFrame, some: DataFrame, least: float, block: int, learn: int = 200_000) -> DataFrame:
    """Candidates among texts of which one has at most SHORT word pairs; none that is linked is missed.

    Any one order of the word pairs is right; it is fast if frequent ones come last, so how frequent they are is
    estimated, by their upper 18 bits, from about `learn` texts.
    """
    own = some.where(F.col("pairs") <= int(SHORT / least)).select("node", "ball")
    short = saved(rows.where(F.col("pairs") <= int(SHORT / least)).select(F.col("rid").alias("node"), "low").join(own, "node"), "short")
    n = short.count()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(1 << 18, np.int64)
        for b in batches:
            times += np.bincount(_flat(b.column("low"))[0] >> np.uint32(14), minlength=1 << 18)
        k = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(times[k])], names=["k", "times"])

    counted = short.where(F.pmod(F.xxhash64("node"), F.lit(max(1, n // learn))) == 0).mapInArrow(tally, "k long, times long").groupBy("k").agg(F.sum("times").alias("times")).toPandas()
    times = np.zeros(1 << 18, np.int32)
    times[counted.k.to_numpy()] = np.minimum(counted.times.to_numpy(), 2**31 - 1)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, size = _flat(b.column("low"))
            doc = np.repeat(np.arange(len(size)), size)
            o = np.lexsort((v, times[v >> np.uint32(14)], doc))
            place = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)
            k = np.flatnonzero(place <= size[doc] - np.ceil(least * size - 1e-9).astype(np.int64)[doc])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (v[o[k]].astype(np.int64), b.column("ball").to_numpy()[doc[k]], place[k], size[doc[k]])], names=["key", "ball", "place", "size"])

    keys = short.select("ball", "low").mapInArrow(prefix, "key long, ball long, place long, size long")
    hot = saved(_hot(keys.groupBy("key").count(), block), "hot")
    return _spread(keys, hot, block, max(1, n * SHORT // (8 * block))).groupBy("bin").applyInPandas(_in_prefixes(least), "a long, b long")


def _spread(rows: DataFrame, sizes: DataFrame, block: int, bins: int) -> DataFrame:
    """`rows` (key, ball, ...) with side and bin: nodes of more than `block` rows (`sizes`: key, parts) become pairs of blocks, the others share bins."""
    plain = rows.withColumns({"side": F.lit(0), "bin": F.pmod(F.xxhash64("key"), F.lit(bins))})
    hot = sizes.count()
    if not hot:
        return plain
    joined = rows.join(F.broadcast(sizes) if hot <= 100_000 else sizes, "key", "left")
    mine = joined.where("parts is not null").withColumn("i", F.pmod(F.xxhash64("ball"), F.col("parts")).cast("int"))
    other = mine.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    # within a block as a node of its own; across, as left and right
    other = other.withColumns({"side": F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2), "bin": F.xxhash64("key", lo, hi)})
    return joined.where("parts is null").drop("parts").withColumns({"side": F.lit(0), "bin": F.pmod(F.xxhash64("key"), F.lit(bins))}).unionByName(other.select(*rows.columns, "side", "bin"))


def _hot(counts: DataFrame, block: int) -> DataFrame:
    return counts.where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("parts"))


def _forest(balls: DataFrame, n: int, depth: int, tries: int, leaf: int, far: int, block: int) -> DataFrame:
    """Candidates of the tries among the balls' centres."""
    orders, at = bit_orders(tries), max(0, depth - 3)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            k = prefixes(np.stack([b.column(c).to_numpy() for c in ("f0", "f1")], axis=1).view(np.uint64), orders, at)
            for t in range(len(orders)):
                yield pa.RecordBatch.from_arrays([pa.array(k[:, t] + (np.int64(t) << 40)), b.column("ball"), b.column("f0"), b.column("f1")], names=["key", "ball", "f0", "f1"])

    rows = balls.select("ball", "f0", "f1").mapInArrow(spread, "key long, ball long, f0 long, f1 long")
    sizes = saved(_hot(rows.groupBy("key").count(), block), "hot")
    bins = max(1, n * tries // block)
    return _spread(rows, sizes, block, bins).groupBy("bin").applyInPandas(_in_tries(orders, at, depth, leaf, far), "a long, b long")


def _keys(texts: DataFrame, bands: Bands, most: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """key, node and `also` (long columns) for each of the first `most` bands of each text; equal rows of a batch once."""
    take = range(min(most or bands.count, bands.count))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.zeros((b.num_rows, bands.count, 8), np.uint8)
            raw[:, :, :5] = np.frombuffer(b"".join(b.column("bands").to_pylist()), np.uint8).reshape(b.num_rows, bands.count, 5)
            k = raw.view(np.int64)[:, :, 0]
            node, more = b.column("node").to_numpy(), [b.column(c).to_numpy() for c in also]
            for t in take:
                d = np.stack([k[:, t] + (np.int64(t) << 40), node, *more], axis=1)
                o = np.lexsort(d.T[::-1])
                d = d[o]
                d = d[np.r_[True, (d[1:] != d[:-1]).any(axis=1)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in d.T], names=["key", "node", *also])

    return texts.select("node", "bands", *also).mapInArrow(rows, "key long, node long" + "".join(f", {c} long" for c in also))


def _heavy(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """`roles` (node, ...) with the word pairs of their nodes: of the wide table only their rows are shuffled, and those only where the roles are many."""
    wide = rows.select(F.col("rid").alias("node"), "low")
    if roles.count() <= 100_000:
        return wide.join(F.broadcast(roles), "node")
    nodes = saved(roles.select("node").distinct(), "nodes")
    if nodes.count() <= 1_000_000:
        wide = wide.join(F.broadcast(nodes), "node", "left_semi")
    return wide.join(roles, "node")


def _assign(half: float):
    def check(d: pd.DataFrame) -> pd.DataFrame:
        """Members (node, centre, distance) that are near enough to the centre that they were proposed to."""
        out = []
        for (centre, _), g in d.groupby(["centre", "part"]):
            node = g.node.to_numpy()
            own = np.flatnonzero(node == centre)
            if not len(own):
                continue
            others = np.flatnonzero(node != centre)
            dist = 1 - Sets(g.low.tolist()).jaccard(int(own[0]), others)
            ok = dist <= half
            out.append(pd.DataFrame({"node": node[others[ok]], "centre": centre, "dist": dist[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"node": np.zeros(0, np.int64), "centre": np.zeros(0, np.int64), "dist": np.zeros(0)})

    return check


def _balls(rows: DataFrame, texts: DataFrame, bands: Bands, half: float, block: int, votes: int = 3, ask: int = 16) -> DataFrame:
    """node, centre, dist: texts at most `half` from a centre. All texts of a ball are linked, so they needn't be paired.

    A text is proposed to the first text of the nodes that it shares in most of `ask` bands. Rounds go on with those
    that found no centre while they still gather some.
    """
    members, pool = None, _keys(texts.withColumn("free", F.lit(1).cast("long")), bands, ask, ("free",))
    while True:
        # centres that have members come first and don't ask
        first = pool.groupBy("key").agg(F.min(F.struct("free", "node")).alias("c"), F.count("*").alias("n")).where("n > 1").select("key", "c")
        asked = pool.join(first, "key").where("free = 1 and (c.free = 0 or c.node < node)").groupBy("node", F.col("c.node").alias("centre")).count().where(F.col("count") >= min(votes, bands.count))
        asked = saved(asked.groupBy("node").agg(F.min(F.struct((-F.col("count")).alias("v"), "centre")).alias("r")).select("node", "r.centre"), "asked")
        n = asked.count()
        if not n:
            break
        parts = asked.groupBy("centre").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
        mine = asked.join(parts, "centre").select("node", "centre", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
        roles = saved(mine.unionByName(parts.select(F.col("centre").alias("node"), "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))), "roles")
        bin_ = F.pmod(F.xxhash64("centre", "part"), F.lit(max(1, n // 1000)))
        near_ = saved(_heavy(rows, roles).withColumn("bin", bin_).groupBy("bin").applyInPandas(_assign(half), "node long, centre long, dist double"), "near")
        good = saved(near_.join(near_.select(F.col("node").alias("centre")).distinct(), "centre", "left_anti").select("node", "centre", "dist"), "balls")
        members = good if members is None else members.unionByName(good)
        got = good.count()
        if got * 20 < n:
            break
        # those that asked or were asked for, less the new members
        full = members.select(F.col("centre").alias("node"), F.lit(0).cast("long").alias("free")).distinct()
        left = roles.select("node").distinct().join(good.select("node"), "node", "left_anti").join(full, "node", "left").withColumn("free", F.coalesce("free", F.lit(1).cast("long")))
        pool = _keys(texts.select("node", "bands").join(saved(left, "left"), "node"), bands, ask, ("free",))
    none = texts.where("false").select("node", F.col("node").alias("centre"), F.lit(0.0).alias("dist"))
    return none if members is None else members


def _measure(d: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
    """The distance of each pair (a, b) whose sets are among the members."""
    if not len(p):
        return p.assign(d=np.zeros(0)).drop(columns="bin")
    sets = Sets(d.low.tolist())
    node = d.node.to_numpy()
    o = np.argsort(node)
    p = p.sort_values("a", kind="stable")
    a, b = (o[np.searchsorted(node, p[c].to_numpy(), sorter=o)] for c in ("a", "b"))
    cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
    return p.assign(d=np.concatenate([1 - sets.jaccard(int(a[k]), b[k:z]) for k, z in zip(cut[:-1], cut[1:])])).drop(columns="bin")


def _cross(least: float):
    def count(d: pd.DataFrame) -> pd.DataFrame:
        """Links of each member of two balls (or blocks of them) with the other's: a, b, node, extra."""
        out = []
        for (a, b, _, _), g in d.groupby(["a", "b", "i", "j"]):
            l, r = np.flatnonzero(g.side.to_numpy() == 1), np.flatnonzero(g.side.to_numpy() == 2)
            if not len(l) or not len(r):
                continue
            sets, nr = Sets(g.low.tolist()), np.zeros(len(g), np.int64)
            for k in l:
                hit = sets.jaccard(int(k), r) >= least
                nr[k] = hit.sum()
                nr[r] += hit
            some = np.flatnonzero(nr)
            out.append(pd.DataFrame({"a": a, "b": b, "node": g.node.to_numpy()[some], "extra": nr[some]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "b", "node", "extra")})

    return count


def _digest(raw: np.ndarray, off: np.ndarray, doc: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text as two longs, and the number by which a row is known: its doc_id, or one made from its text."""
    view = memoryview(np.ascontiguousarray(raw))
    th = np.array([np.frombuffer(hashlib.blake2b(view[a:z], digest_size=16).digest(), np.int64) for a, z in zip(off[:-1].tolist(), off[1:].tolist())]).reshape(-1, 2)
    return th, np.where(np.asarray(doc.is_null()), -1 - (th[:, 0] & ((1 << 62) - 1)), doc.fill_null(0).to_numpy(zero_copy_only=False))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), n_links (other texts linked with its text), n_copies (rows of its text), kept. Options: those of `classes`."""
    return classes(docs, **options).drop("known")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with all its columns: that of the smallest doc_id; where several rows have it, the first by text and then by the hash of the row."""
    found = saved(classes(docs, **options).select("known", "class_id"), "classes")
    name = "_known"
    while name in docs.columns:
        name += "_"
    drop = saved(found.where("known <> class_id").select(F.col("known").alias(name)).distinct(), "drop")
    # numbers alone: up to 2 million of them are sent to the texts rather than all texts shuffled
    drop = F.broadcast(drop) if drop.count() <= 2_000_000 else drop

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            _, known = _digest(*text_buffer(b.column("text")), b.column("doc_id").cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(known)], names=[*b.schema.names, name])

    schema = type(docs.schema)([*docs.schema.fields]).add(name, "long")
    kept = docs.mapInArrow(tag, schema).join(drop, name, "left_anti")
    if found.groupBy("known").count().where("count > 1").limit(1).count():
        # the first of its rows: by partial aggregate, as one doc_id may be frequent
        own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        kept = kept.groupBy(name).agg(F.min_by(own, F.struct(F.col("text"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))).alias("r")).select("r.*")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _audit(rows: DataFrame, texts: DataFrame, least: float, size: int) -> DataFrame:
    """a, b: all pairs of index at least `least` of sampled texts a with any text b, by brute force over all texts."""
    some = saved(_heavy(rows, texts.where("words > 0").orderBy(F.xxhash64("node", F.lit(5)), "node").limit(size).select("node")), "sample").toPandas()
    node = some.node.to_numpy()
    sets = [np.frombuffer(s, np.uint32) for s in some.low]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
    o = np.argsort(value, kind="stable")
    value, owner, sizes = value[o], owner[o], np.array([len(s) for s in sets])
    names, at = np.unique(value, return_index=True)
    at = np.append(at, len(value))

    table = np.zeros(1 << 16, bool)
    table[names >> np.uint32(16)] = True

    def meet(low: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, sampled text and how many word pairs they share, of those that share any."""
        raw = low.to_pylist()
        flat = np.frombuffer(b"".join(raw), np.uint32)
        doc = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
        keep = table[flat >> np.uint32(16)]
        flat, doc = flat[keep], doc[keep]
        k = np.minimum(np.searchsorted(names, flat), len(names) - 1)
        keep = names[k] == flat
        k, doc = k[keep], doc[keep]
        times = at[k + 1] - at[k]
        pair, same = np.unique(np.repeat(doc, times) * len(sets) + owner[ragged(at[k], times)], return_counts=True)
        return pair // len(sets), pair % len(sets), same

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(names):
                continue
            every = np.array([len(x) // 4 for x in b.column("low").to_pylist()])
            cut = np.unique(np.searchsorted(np.cumsum(every), np.arange(0, every.sum() + 1, 1 << 17)))
            for first, last in zip(cut, np.append(cut[1:], b.num_rows)):
                d, s, same = meet(b.column("low").slice(first, last - first))
                d += first
                ok = same >= least * (every[d] + sizes[s] - same)
                x, y = node[s[ok]], b.column("rid").to_numpy()[d[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(x[x != y]), pa.array(y[x != y])], names=["a", "b"])

    return saved(rows.select("rid", "low").mapInArrow(scan, "a long, b long").join(texts.select(F.col("node").alias("b")), "b", "left_semi"), "audit")


def _recall(true: DataFrame, texts: DataFrame, pairs: DataFrame) -> float:
    """The share of its links whose balls are one or a candidate pair, as a mean over sampled texts that have any."""
    of = lambda x: texts.select(F.col("node").alias(x), F.col("ball").alias(f"b{x}"))
    own = true.join(of("a"), "a").join(of("b"), "b").select(F.col("a").alias("text"), F.least("ba", "bb").alias("a"), F.greatest("ba", "bb").alias("b"))
    own = own.join(pairs.select("a", "b", F.lit(1).alias("met")), ["a", "b"], "left").groupBy("text").agg(F.avg(F.when(F.col("a") == F.col("b"), 1).otherwise(F.coalesce("met", F.lit(0)))).alias("share"))
    share = own.agg(F.avg("share")).head()[0]
    return 1.0 if share is None else share


def classes(docs: DataFrame, least: float = 0.5, far: int = 34, recall: float = 0.98, target: float = 0.95, tries: int = 16, leaf: int = 256, block: int = 20_000, audit: int = 256) -> DataFrame:
    """known (doc_id, or a negative number made from the text), doc_id, class_id, n_links, n_copies, kept for each row."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bands = Bands.of(docs.select("doc_id").count(), least, recall)
    half = (1 - least) / 2

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            raw, off = text_buffer(b.column("text"))
            fp, count, low, at, keys, sig = features(raw, off, bands)
            doc = b.column("doc_id")
            th, known = _digest(raw, off, doc)
            f = fp.view(np.int64)
            cut = [low[a:z].tobytes() for a, z in zip(at[:-1], at[1:])]
            short = np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), -1, 8)[:, :, :5]
            names = ["doc_id", "known", "t0", "t1", "f0", "f1", "words", "pairs", "bands", "low", *[f"s{k}" for k in range(sig.shape[1])]]
            yield pa.RecordBatch.from_arrays([doc, *map(pa.array, (known, np.ascontiguousarray(th[:, 0]), np.ascontiguousarray(th[:, 1]), np.ascontiguousarray(f[:, 0]), np.ascontiguousarray(f[:, 1]), count, np.diff(at))), pa.array([k.tobytes() for k in short], pa.binary()), pa.array(cut, pa.binary()), *[pa.array(np.ascontiguousarray(s)) for s in sig.T]], names=names)

    signature = [f"s{k}" for k in range(SIGNATURE // 64)]
    schema = "doc_id long, known long, t0 long, t1 long, f0 long, f1 long, words long, pairs long, bands binary, low binary, " + ", ".join(f"{s} long" for s in signature)
    # a number for each row; those of equal texts are told by their digests
    rows = saved(docs.mapInArrow(feature_rows, schema).withColumn("rid", F.monotonically_increasing_id()), "features")
    own = F.struct(F.col("rid").alias("node"), "f0", "f1", "words", "pairs", "bands", *signature)
    texts = rows.groupBy("t0", "t1").agg(F.min(own).alias("r"), F.count("*").alias("n_copies"), F.min("known").alias("least_known")).select("t0", "t1", "r.*", "n_copies", "least_known")
    texts = saved(texts, "texts")
    some = texts.where("words > 0")
    members = saved(_balls(rows, some, bands, half, 4096), "members")
    texts = saved(texts.join(members, "node", "left").withColumns({"ball": F.coalesce("centre", "node"), "dist": F.coalesce("dist", F.lit(0.0))}).drop("centre"), "texts")
    some = texts.where("words > 0")
    balls = some.groupBy("ball").agg(F.count("*").alias("points"), F.max("dist").alias("radius"), F.min("pairs").alias("few"), F.max("pairs").alias("most"))
    centres = some.where("node = ball").select("ball", "f0", "f1", *signature).join(balls, "ball")
    centres = saved(centres, "centres")
    n = centres.count()

    # candidates: what has only short texts is found by the prefix filter alone
    long = some.where(F.col("pairs") > SHORT)
    tall = centres.where(F.col("most") > SHORT)
    n_tall = tall.count()
    named = long.withColumnRenamed("node", "text").select(F.col("ball").alias("node"), "bands", F.col("pairs").alias("few"), F.col("pairs").alias("most"))
    keys = _keys(named, bands, also=("few", "most")).withColumnRenamed("node", "ball")
    hot = saved(_hot(_keys(long, bands).groupBy("key").count(), block), "hot")
    of_bands = _spread(keys, hot, block, max(1, n_tall * bands.count // (4 * block))).groupBy("bin").applyInPandas(_in_bands(least), "a long, b long")
    depth = depth_for(n_tall, leaf)
    of_tries = _forest(tall, n_tall, depth, tries, leaf, far, block)
    pairs = saved(of_bands.union(of_tries).union(_short(rows, some, least, block)).distinct(), "candidates")
    true = _audit(rows, texts, least, audit)
    while depth and _recall(true, texts, pairs) < target:  # climb
        depth = max(0, depth - 3)
        pairs = saved(pairs.union(_forest(tall, n_tall, depth, tries, leaf, BITS if not depth else far + 8, block)).distinct(), "candidates")

    # verification: signatures leave out most chance meetings, word pairs decide
    ball = lambda x: centres.select(F.col("ball").alias(x), F.col("radius").alias(f"r{x}"), F.col("points").alias(f"p{x}"), *[F.col(s).alias(f"{s}{x}") for s in signature])
    apart = sum((F.bit_count(F.col(f"{s}a").bitwiseXOR(F.col(f"{s}b"))) for s in signature), F.lit(0))
    reach = F.least(F.lit(1.0), F.lit(1 - least) + F.col("ra") + F.col("rb"))
    # of SIGNATURE bits, a pair at distance d differs in d / 2 of them; four standard deviations more
    most = F.lit(SIGNATURE) * reach / 2 + 4 * F.sqrt(F.lit(SIGNATURE) * reach / 2 * (1 - reach / 2))
    few = saved(pairs.join(ball("a"), "a").join(ball("b"), "b").where(apart <= most).select("a", "b", "ra", "rb", "pa", "pb"), "likely")
    p = few.count()
    slots, bins = max(1, n // 3000), max(1, p // 8000)
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(slots))
    few = few.withColumn("bin", F.pmod(F.xxhash64(F.least(slot("a"), slot("b")), F.greatest(slot("a"), slot("b"))), F.lit(bins)))
    where = saved(few.select(F.col("a").alias("node"), "bin").union(few.select("b", "bin")).distinct(), "where")
    got = "a long, b long, ra double, rb double, pa long, pb long, d double"
    measured = saved(_heavy(rows, where).groupBy("bin").cogroup(few.groupBy("bin")).applyInPandas(_measure, got), "measured")
    lone = (F.col("pa") == 1) & (F.col("pb") == 1)
    edge = F.col("d") <= 1 - least + 1e-12
    certain = F.when(lone, edge).otherwise(F.col("d") + F.col("ra") + F.col("rb") < 1 - least - 1e-9)
    sure = measured.where(certain)
    open_ = saved(measured.where(~certain & ~lone & (F.col("d") - F.col("ra") - F.col("rb") <= 1 - least + 1e-9)).select("a", "b", "pa", "pb"), "open")
    # balls that may be linked in part: text by text, a block of one against a block of the other
    parts = lambda x: F.ceil(F.col(x) / 2048).cast("int")
    point = some.select("node", F.col("ball"))
    left = open_.join(point.withColumnRenamed("ball", "a"), "a").select("a", "b", "node", F.lit(1).alias("side"), F.pmod(F.xxhash64("node"), parts("pa")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), parts("pb") - 1)).alias("j"))
    right = open_.join(point.withColumnRenamed("ball", "b"), "b").select("a", "b", "node", F.lit(2).alias("side"), F.explode(F.sequence(F.lit(0), parts("pa") - 1)).alias("i"), F.pmod(F.xxhash64("node"), parts("pb")).cast("int").alias("j"))
    roles = saved(left.union(right), "roles")
    many = max(1, roles.count() // 2000)
    group = F.pmod(F.xxhash64("a", "b", "i", "j"), F.lit(many))
    checked = saved(_heavy(rows, roles).withColumn("bin", group).groupBy("bin").applyInPandas(_cross(least), "a long, b long, node long, extra long"), "checked")

    # classes; rows of one doc_id are one document: their texts are joined as well
    by_doc = rows.select("known", "t0", "t1").distinct().groupBy("known").count().where("count > 1").select("known")
    joint = rows.select("known", "t0", "t1").join(by_doc, "known").join(texts.select("t0", "t1", "ball"), ["t0", "t1"]).select("known", "ball").distinct()
    same = joint.join(joint.groupBy("known").agg(F.min("ball").alias("first")), "known").select("ball", "first")
    root = components(sure.select("a", "b").union(checked.select("a", "b").distinct()).union(same))
    by_ball = sure.select(F.col("a").alias("ball"), F.col("pb").alias("w")).union(sure.select("b", "pa")).groupBy("ball").agg(F.sum("w").alias("around"))
    by_text = checked.groupBy("node").agg(F.sum("extra").alias("extra"))
    zero = F.lit(0).cast("long")
    info = texts.groupBy("ball").agg(F.min("least_known").alias("least_known"), F.count("*").alias("points")).join(root.withColumnRenamed("node", "ball"), "ball", "left").withColumn("root", F.coalesce("root", "ball")).join(by_ball, "ball", "left")
    info = saved(info, "info")
    first = info.groupBy("root").agg(F.min("least_known").alias("class_id"))
    of_ball = info.join(first, "root").select("ball", "class_id", (F.col("points") - 1 + F.coalesce("around", zero)).alias("links"))
    of_text = texts.select("t0", "t1", "node", "ball", "n_copies").join(of_ball, "ball").join(by_text, "node", "left").select("t0", "t1", "class_id", (F.col("links") + F.coalesce("extra", zero)).alias("n_links"), "n_copies")
    return rows.select("doc_id", "known", "t0", "t1").join(of_text, ["t0", "t1"]).select("known", "doc_id", "class_id", "n_links", "n_copies", (F.col("known") == F.col("class_id")).alias("kept"))
