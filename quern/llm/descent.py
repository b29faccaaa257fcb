"""Near-duplicate vectors by NN-descent.

Equal vectors are one point. Points are first gathered into balls: a point joins a centre from which it is at most half
the threshold angle away, so that all points of a ball are linked and needn't be paired. Centres (lone points too) are
the nodes of the neighbour graph. Its lists start from the leaves of random-hyperplane trees and are refined by joins of
neighbours with neighbours of neighbours (Dong et al., "Efficient k-nearest neighbor graph construction", 2011); a list
all of whose members are near enough to hold links is saturated and doubled. All centre pairs whose balls may hold a
link (angle at most threshold + both radii) are kept as edges, whether or not they fit the lists. So many trees are
grown that two points at the threshold share a leaf with the chance `recall`, which isolated pairs depend on. The recall
of the edges is then audited against all centres, as a mean over sampled centres that have any; the sample grows until
there are enough of them to tell `recall` from 1, or holds all centres and so all edges. Until `recall` is reached, more
trees and another round of refinement follow; after `most_rounds`, all centres are compared in blocks. The pairs that
the audit saw are edges as well. Edges between balls so near that every pair is linked are counted as a whole; the
others are verified point by point, in double precision, in blocks. The way is the same for tables of any size.

Leaves, adjacency sets and balls beyond a bounded size are split into blocks (all pairs of blocks for leaves and
balls), so no task holds an unbounded group.

Defined results: vectors that are null, empty, zero or have a null or non-finite component, and rows without vec_id,
have no links and are their own components (a null vec_id: component_id null, kept); vectors of different lengths
aren't linked; rows of one vec_id are one vector (the least in the order of arrays, if they differ); equal vectors are linked; an empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship
from .components import components
from .vectors import matrix, usable

_SLACK = 2e-6


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (_unit(a) * _unit(b)).sum(axis=1)


def _planes(table: int, depth: int, dim: int) -> np.ndarray:
    return np.random.default_rng(1000 + table).standard_normal((dim, max(depth, 1)))[:, :depth]


def trees_for(depth: int, theta: float, recall: float) -> int:
    """So many trees of random hyperplanes that two points at the angle theta share a leaf with the chance `recall`."""
    one = (1 - theta / math.pi) ** depth
    return 1 if one >= 1 else max(1, math.ceil(math.log(max(1 - recall, 1e-6)) / math.log(1 - one)))


def _leaf_keys(x: np.ndarray, table: int, depth: int) -> np.ndarray:
    bits = (x @ _planes(table, depth, x.shape[1]) > 0).astype(np.int64) if depth else np.zeros((len(x), 0), np.int64)
    return (bits << np.arange(bits.shape[1])).sum(axis=1) + (np.int64(table) << 32) + (np.int64(x.shape[1]) << 48)


def _leaves(points: DataFrame, tables: range, depth: int, block: int) -> DataFrame:
    """`points` (c, v, r) once for each table, with group, side: the rows of one group are to be compared, those of side 1 with those of side 2 if any."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if not len(d):
                continue
            for dim, part in d.groupby(d.v.str.len()):
                x = np.frombuffer(b"".join(part.v), np.float32).reshape(len(part), -1)
                for t in tables:
                    yield part.assign(key=_leaf_keys(x, t, depth))

    rows = points.mapInPandas(spread, "c long, v binary, r double, key long")
    sizes = rows.select("key").groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    sizes = saved(sizes, "sizes")
    if not sizes.limit(1).count():
        return rows.withColumns({"side": F.lit(0), "group": F.xxhash64("key")}).drop("key")
    joined = rows.join(sizes, "key", "left").withColumn("i", F.pmod(F.xxhash64("c"), F.coalesce("parts", F.lit(1))).cast("int"))
    joined = joined.withColumn("j", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2)
    return joined.withColumns({"side": side, "group": F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j"))}).select("c", "v", "r", "side", "group")


def _join_balls(d: pd.DataFrame, half: float) -> pd.DataFrame:
    """Points (r < 0) that join a centre: c, centre, angle."""
    d = d.sort_values(["full", "c"], ascending=[False, True], kind="stable")
    c, full = d.c.to_numpy(), d.full.to_numpy()
    x = np.frombuffer(b"".join(d.v), np.float32).reshape(len(d), -1)
    centre = np.full(len(d), -1)
    least = np.cos(half) + _SLACK
    has = np.zeros(len(d), bool)
    near = []
    for k in range(0, len(d), 1024):
        s = x[k : k + 1024] @ x.T
        i, j = np.nonzero(s >= least)
        m = i + k > j  # an earlier row
        near.append(np.stack([i[m] + k, j[m]]))
    i, j = np.concatenate(near, axis=1) if near else np.zeros((2, 0), np.int64)
    cut = np.searchsorted(i, np.arange(len(d) + 1))
    for p in np.unique(i):
        if full[p]:
            continue  # it has members of its own
        for q in j[cut[p] : cut[p + 1]]:
            if centre[q] < 0 and not has[p]:
                centre[p], has[q] = q, True
                break
    got = np.flatnonzero(centre >= 0)
    to = centre[got]
    a = np.arccos(np.clip((x[got].astype(np.float64) * x[to]).sum(axis=1), -1, 1)) + 1e-4  # of rounded vectors
    return pd.DataFrame({"c": c[got], "centre": c[to], "angle": a})


def _pairs_of_group(d: pd.DataFrame, keep: int, theta: float) -> pd.DataFrame:
    """The `keep` nearest of each row, and the pairs whose balls may hold links: a, b, s, edge."""
    out = []
    for _, g in d.groupby("group"):
        if len(g) < 2:
            continue
        l, r = (g, g) if g.side.iloc[0] == 0 else (g[g.side == 1], g[g.side == 2])
        if not len(l) or not len(r):
            continue
        x = np.frombuffer(b"".join(l.v), np.float32).reshape(len(l), -1)
        y = np.frombuffer(b"".join(r.v), np.float32).reshape(len(r), -1)
        out.append(_near(x, l.c.to_numpy(), l.r.to_numpy(), y, r.c.to_numpy(), r.r.to_numpy(), keep, theta))
        if l is not r:
            out.append(_near(y, r.c.to_numpy(), r.r.to_numpy(), x, l.c.to_numpy(), l.r.to_numpy(), keep, theta))
    return pd.concat(out) if out else _no_pairs()


def _no_pairs() -> pd.DataFrame:
    return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "s": np.zeros(0, np.float32), "edge": np.zeros(0, bool)})


def _within(s: np.ndarray, ra: np.ndarray, rb: np.ndarray, theta: float) -> np.ndarray:
    """Whether balls of radii ra, rb whose centres have cosine s may hold a link (s: of single precision)."""
    return s >= np.cos(np.minimum(np.pi, theta + ra + rb)) - 1e-5


def _near(x, cx, rx, y, cy, ry, keep: int, theta: float) -> pd.DataFrame:
    a, b, s_, e_ = [], [], [], []
    wide = float(np.cos(min(np.pi, theta + rx.max() + ry.max()))) - 1e-5
    for k in range(0, len(x), 1024):
        s = x[k : k + 1024] @ y.T
        s[cx[k : k + 1024, None] == cy[None, :]] = -2
        i, j = np.nonzero(s >= wide)
        ok = _within(s[i, j], rx[i + k], ry[j], theta)
        a.append(cx[i[ok] + k]), b.append(cy[j[ok]]), s_.append(s[i[ok], j[ok]]), e_.append(np.ones(ok.sum(), bool))
        m = min(keep, s.shape[1])
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        v = s[np.arange(len(s))[:, None], top]
        i, j = np.nonzero(v > -1.5)
        a.append(cx[i + k]), b.append(cy[top[i, j]]), s_.append(v[i, j]), e_.append(np.zeros(len(i), bool))
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "s": np.concatenate(s_), "edge": np.concatenate(e_)})


_PAIR = "a long, b long, s float, edge boolean"


def _local(theta: float, keep: int):
    def join(d: pd.DataFrame) -> pd.DataFrame:
        """Pairs among the neighbours of each node that improve a list or may hold links."""
        d = d.sort_values(["node", "part"], kind="stable")
        start = np.flatnonzero(np.r_[True, (np.diff(d.node) != 0) | (np.diff(d.part) != 0)]) if len(d) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(d)))
        c, r, worst = d.u.to_numpy(), d.r.to_numpy(), d.worst.to_numpy()
        out = []
        for dim, own in d.groupby(d.v.str.len().to_numpy()).indices.items():
            pos = np.full(len(d), -1)
            pos[own] = np.arange(len(own))
            x = np.frombuffer(b"".join(d.v.iloc[own]), np.float16).astype(np.float32).reshape(len(own), -1)
            of = np.flatnonzero((pos[start] >= 0) & (size > 1))
            of = of[np.argsort(size[of], kind="stable")]
            for k in range(0, len(of), 256):
                some = of[k : k + 256]
                w = int(size[some].max())
                ix = start[some][:, None] + np.minimum(np.arange(w)[None, :], size[some][:, None] - 1)
                real = np.arange(w)[None, :] < size[some][:, None]
                m = x[pos[ix]]
                s = np.matmul(m, m.transpose(0, 2, 1))
                ok = real[:, :, None] & real[:, None, :] & (c[ix][:, :, None] != c[ix][:, None, :])
                better = ok & (s > worst[ix][:, :, None] + 1e-3)
                # half precision: a margin
                edge = ok & (s >= np.cos(np.minimum(np.pi, theta + r[ix][:, :, None] + r[ix][:, None, :])) - 3e-3)
                t, i, j = np.nonzero(better | edge)
                out.append(pd.DataFrame({"a": c[ix[t, i]], "b": c[ix[t, j]], "s": s[t, i, j], "edge": edge[t, i, j]}))
        if not out:
            return _no_pairs()
        p = pd.concat(out).drop_duplicates(["a", "b"])
        p = p.sort_values(["a", "s"], ascending=[True, False], kind="stable")
        return p[p.edge | (p.groupby("a").cumcount() < keep)]

    return join


def _lists(pairs: DataFrame, sizes: DataFrame | None, keep: int) -> DataFrame:
    """The nearest of each node, as many as its list holds: a, b, s, k."""
    best = pairs.groupBy("a", "b").agg(F.max("s").alias("s"))
    best = best.withColumn("k", F.lit(keep)) if sizes is None else best.join(sizes, "a", "left").withColumn("k", F.coalesce("k", F.lit(keep)))
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return saved(best.withColumn("nth", nth).where("nth <= k").drop("nth"), "lists")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, keep: int = 8, leaf: int = 512, block: int = 4096, trees: int | None = None, ball_rounds: int = 3, rounds: int = 2, recall: float = 0.995, audit: int = 512, most_rounds: int = 8) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector."""
    spark = vectors.sparkSession
    ship(spark)
    theta = float(np.arccos(cosine))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    ids = every.select("vec_id").distinct()
    rows = usable(every).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumns({"h0": F.xxhash64("embedding"), "h1": F.xxhash64(F.lit(7), "embedding")})
    rows = saved(rows, "vectors")
    points = saved(rows.groupBy("h0", "h1").agg(F.min("vec_id").alias("c"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")), "points")

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                u = [_unit(np.asarray(e, np.float64)[None])[0].astype(np.float32).tobytes() for e in d.embedding]
                yield pd.DataFrame({"c": d.c, "v": u, "r": 0.0})

    units = saved(points.select("c", "embedding").mapInPandas(single, "c long, v binary, r double"), "units")
    n = units.count()
    depth = max(1, int(np.ceil(np.log2(max(1, n) / leaf))))
    trees = trees or trees_for(depth, theta, recall)

    # balls
    members = None  # c, centre, angle
    half = theta / 2 - 2e-4
    free = units.withColumn("full", F.lit(False))
    for k in range(ball_rounds):
        groups = _leaves(free.select("c", "v", F.col("full").cast("double").alias("r")), range(100 + k, 101 + k), depth, block)
        # a ball is made within one block: blocks of one leaf aren't paired for this
        own = groups.where("side = 0").withColumn("full", F.col("r") > 0).select("c", "v", "full", "group")
        new = saved(own.groupBy("group").applyInPandas(lambda d: _join_balls(d, half), "c long, centre long, angle double"), "balls")
        members = new if members is None else members.unionByName(new)
        gone, has = new.select("c").distinct(), members.select(F.col("centre").alias("c"), F.lit(True).alias("has")).distinct()
        free = saved(units.join(members.select("c"), "c", "left_anti").join(has, "c", "left").select("c", "v", "r", F.coalesce("has", F.lit(False)).alias("full")), "free")
        del gone
    members = saved(members, "members")
    weight = points.select("c", "copies").join(members, "c", "left").select("c", "copies", F.coalesce("centre", "c").alias("centre"), F.coalesce("angle", F.lit(0.0)).alias("angle"))
    weight = saved(weight, "weights")
    balls = saved(weight.groupBy("centre").agg(F.sum("copies").alias("weight"), F.count("*").alias("points"), F.max("angle").alias("radius"), F.min("c").alias("least")), "balls")
    nodes = saved(units.join(balls.select(F.col("centre").alias("c"), "radius"), "c").select("c", "v", F.col("radius").alias("r")), "nodes")
    widest = nodes.agg(F.max("r")).head()[0] or 0.0

    # the neighbour graph
    def seek(tables: range) -> DataFrame:
        d = _leaves(nodes, tables, depth, block)
        bins = max(8, n * len(tables) // (8 * leaf))
        return saved(d.withColumn("bin", F.pmod("group", F.lit(bins))).groupBy("bin").applyInPandas(lambda g: _pairs_of_group(g, keep, theta), _PAIR), "pairs")

    found = seek(range(trees))
    edges = found.where("edge")
    sizes, used = None, trees
    lists = _lists(found, sizes, keep)
    sample = None
    for done in range(most_rounds):
        for _ in range(rounds if not done else 1):
            found = _descend(nodes, lists, theta, keep, done, n)
            edges = edges.unionByName(found.where("edge"))
            both = lists.select("a", "b", "s").unionByName(found.select("a", "b", "s"))
            lists = _lists(both, sizes, keep)
            full = lists.groupBy("a").agg(F.min("s").alias("last"), F.count("*").alias("n"), F.first("k").alias("k")).where("n >= k").join(nodes.select(F.col("c").alias("a"), "r"), "a")
            full = saved(full.where(F.col("last") >= F.cos(F.least(F.lit(np.pi), F.lit(theta + widest) + F.col("r"))) - 3e-3).select("a", (F.col("k") * 2).alias("k")), "saturated")
            sizes = full if sizes is None else saved(sizes.unionByName(full).groupBy("a").agg(F.max("k").alias("k")), "sizes")
            if not full.limit(1).count() and not found.limit(1).count():
                break
        if sample is None:
            sample, whole = _audit(nodes, theta, audit, recall)
        if whole or _share(sample, edges) >= recall:
            edges = edges.select("a", "b").unionByName(sample)
            break
        extra = seek(range(used, used + trees))
        used += trees
        edges = edges.unionByName(extra.where("edge"))
        lists = _lists(lists.select("a", "b", "s").unionByName(extra.select("a", "b", "s")), sizes, keep)
    else:
        blocks = _leaves(nodes, range(1), 0, block).groupBy("group")
        edges = saved(blocks.applyInPandas(lambda g: _pairs_of_group(g, 1, theta), _PAIR).where("edge"), "exact")
    pair = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return _count(rows, ids, points, weight, balls, nodes, pair, cosine, theta, block)


def _descend(nodes: DataFrame, lists: DataFrame, theta: float, keep: int, turn: int, n: int) -> DataFrame:
    """Pairs of neighbours of one node."""
    both = lists.select(F.col("a").alias("node"), F.col("b").alias("u")).unionByName(lists.select(F.col("b").alias("node"), F.col("a").alias("u"))).distinct()
    degree = both.groupBy("node").agg(F.ceil(F.count("*") / 64).cast("int").alias("parts")).where("parts > 1")
    both = both.join(degree, "node", "left").withColumn("part", F.pmod(F.xxhash64("u", F.lit(turn)), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    worst = lists.groupBy(F.col("a").alias("c")).agg(F.when(F.count("*") >= F.first("k"), F.min("s")).otherwise(-1.0).cast("float").alias("worst"))

    def halve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            d["v"] = [np.frombuffer(v, np.float32).astype(np.float16).tobytes() for v in d.v]
            yield d

    small = nodes.mapInPandas(halve, nodes.schema).join(worst, "c", "left").select(F.col("c").alias("u"), "v", "r", F.coalesce("worst", F.lit(-1.0)).cast("float").alias("worst"))
    bins = max(8, n // 1000)
    grouped = both.join(small, "u").withColumn("bin", F.pmod(F.xxhash64("node", "part"), F.lit(bins))).groupBy("bin")
    return saved(grouped.applyInPandas(_local(theta, keep), _PAIR), "joined")


def _audit(nodes: DataFrame, theta: float, size: int, recall: float) -> tuple[DataFrame, bool]:
    """All pairs (a, b) that may hold links of sampled nodes a, by brute force over all nodes, and whether all nodes were sampled. The sample grows until enough of its nodes have a pair."""
    enough = math.inf if recall >= 1 else math.ceil(1 / (1 - recall))
    total, at, linked, sample = nodes.count(), 0, 0, None
    while sample is None or (at < total and linked < enough):
        part = saved(_all_pairs(nodes, nodes.orderBy(F.xxhash64("c", F.lit(5)), "c").offset(at).limit(size).toPandas(), theta), "audit")
        linked += part.select("a").distinct().count()
        sample = part if sample is None else sample.unionByName(part)
        at += size
        size = max(size, min(2 * size, 8192))
    return sample, at >= total


def _all_pairs(nodes: DataFrame, some: pd.DataFrame, theta: float) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for dim, g in d.groupby(d.v.str.len()):
                own = some[some.v.str.len() == dim]
                y = np.frombuffer(b"".join(g.v), np.float32).reshape(len(g), -1)
                for k in range(0, len(own), 512):
                    few = own.iloc[k : k + 512]
                    x = np.frombuffer(b"".join(few.v), np.float32).reshape(len(few), -1)
                    i, j = np.nonzero(_within(x @ y.T, few.r.to_numpy()[:, None], g.r.to_numpy()[None, :], theta))
                    a, b = few.c.to_numpy()[i], g.c.to_numpy()[j]
                    yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    return nodes.mapInPandas(scan, "a long, b long")


def _share(sample: DataFrame, edges: DataFrame) -> float:
    """The share of its pairs that a sampled node has among the edges, as a mean over nodes."""
    have = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    found = sample.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(have, ["lo", "hi"], "left_semi").groupBy("a").agg(F.count("*").alias("found"))
    share = sample.groupBy("a").agg(F.count("*").alias("all")).join(found, "a", "left").agg(F.avg(F.coalesce("found", F.lit(0)) / F.col("all"))).head()[0]
    return 1.0 if share is None else share


def _count(rows: DataFrame, ids: DataFrame, points: DataFrame, weight: DataFrame, balls: DataFrame, nodes: DataFrame, pair: DataFrame, cosine: float, theta: float, block: int) -> DataFrame:
    ball = lambda x: balls.select(F.col("centre").alias(x), F.col("radius").alias(f"r{x}"), F.col("points").alias(f"p{x}"), F.col("weight").alias(f"w{x}"))
    vec = lambda x: points.select(F.col("c").alias(x), F.col("embedding").alias(f"e{x}"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                s = np.zeros(len(d))
                for _, i in d.groupby(d.ea.str.len()).indices.items():
                    s[i] = _cosine(matrix(d.ea.iloc[i]), matrix(d.eb.iloc[i]))
                yield d.drop(columns=["ea", "eb"]).assign(s=s)

    full = pair.join(ball("a"), "a").join(ball("b"), "b").join(vec("a"), "a").join(vec("b"), "b").where(F.size("ea") == F.size("eb"))
    full = saved(full.select("a", "b", "ra", "rb", "pa", "pb", "wa", "wb", "ea", "eb").mapInPandas(measure, "a long, b long, ra double, rb double, pa long, pb long, wa long, wb long, s double"), "measured")
    lone = (F.col("pa") == 1) & (F.col("pb") == 1)
    sure = full.where((lone & (F.col("s") >= cosine)) | (~lone & (F.acos(F.least(F.col("s"), F.lit(1.0))) + F.col("ra") + F.col("rb") < theta - 1e-6)))
    open_ = full.where(~lone & (F.acos(F.least(F.col("s"), F.lit(1.0))) + F.col("ra") + F.col("rb") >= theta - 1e-6)).select("a", "b", "pa", "pb")

    # balls that may be linked in part: point by point, a block of one against a block of the other
    parts = lambda p: F.ceil(F.col(p) / block).cast("int")
    own = weight.join(points.select("c", "embedding"), "c").select("c", "copies", "centre", "embedding")
    left = open_.join(own.withColumnRenamed("centre", "a"), "a").select("a", "b", "c", "copies", "embedding", F.pmod(F.xxhash64("c"), parts("pa")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), parts("pb") - 1)).alias("j"))
    right = open_.join(own.withColumnRenamed("centre", "b"), "b").select("a", "b", "c", "copies", "embedding", F.explode(F.sequence(F.lit(0), parts("pa") - 1)).alias("i"), F.pmod(F.xxhash64("c"), parts("pb")).cast("int").alias("j"))

    def verify(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "extra": np.zeros(0, np.int64)})
        if not len(l) or not len(r):
            return none
        x, y = _unit(matrix(l.embedding)), _unit(matrix(r.embedding_))
        wl, wr = l.copies.to_numpy(), r.copies_.to_numpy()
        nl, nr = np.zeros(len(l), np.int64), np.zeros(len(r), np.int64)
        for k in range(0, len(x), 512):
            hit = x[k : k + 512] @ y.T >= cosine
            nl[k : k + 512] = hit @ wr
            nr += wl[k : k + 512] @ hit
        d = pd.DataFrame({"a": l.a.iloc[0], "b": l.b.iloc[0], "c": np.concatenate([l.c, r.c_]), "extra": np.concatenate([nl, nr])})
        return d[d.extra > 0]

    right = right.toDF(*[f"{c}_" for c in right.columns])
    key = ["a", "b", "i", "j"]
    checked = saved(left.groupBy(key).cogroup(right.groupBy([f"{k}_" for k in key])).applyInPandas(verify, "a long, b long, c long, extra long"), "verified")
    joined = components(sure.select("a", "b").unionByName(checked.select("a", "b").distinct()))
    by_ball = sure.select(F.col("a").alias("centre"), F.col("wb").alias("w")).unionByName(sure.select(F.col("b").alias("centre"), F.col("wa").alias("w"))).groupBy("centre").agg(F.sum("w").alias("around"))
    by_point = checked.groupBy("c").agg(F.sum("extra").alias("extra"))
    info = balls.select("centre", "weight", "least").join(joined.withColumnRenamed("node", "centre"), "centre", "left").withColumn("root", F.coalesce("root", "centre")).join(by_ball, "centre", "left")
    info = saved(info, "info")
    smallest = info.groupBy("root").agg(F.min("least").alias("component_id"))
    of_ball = info.join(smallest, "root").select("centre", "component_id", (F.col("weight") - 1 + F.coalesce("around", F.lit(0))).alias("links"))
    of_point = weight.join(of_ball, "centre").join(by_point, "c", "left").select("c", "component_id", (F.col("links") + F.coalesce("extra", F.lit(0))).alias("n_links"))
    of_hash = points.select("h0", "h1", "c").join(of_point, "c").drop("c")
    linked = rows.select("vec_id", "h0", "h1").join(of_hash, ["h0", "h1"]).select("vec_id", "n_links", "component_id")
    alone = ids.join(rows.select("vec_id"), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
