"""Approximate nearest neighbours with a robust-pruned directed graph for each shard.

Vectors are spread over shards by a hash. In each shard points are inserted in growing batches: a greedy beam search
over the graph so far proposes neighbours (all it met), the relaxed rule of Subramanya et al. ("DiskANN", 2019) keeps a
diverse few (a candidate goes if a kept one is `alpha` times nearer to it than the point is), edges back are added and
overfull lists pruned by the same rule. A query is beam-searched in every shard and the shards' lists are merged; the
distances returned are recomputed from the original vectors in double precision.

Equal vectors are one point of the graph, which carries the k + 1 smallest of their ids: more can't be among k
neighbours. The index is a folder of one Parquet file for each shard. A task has a block of the queries and a run of
the shards, whose graphs it reads one after another, so it holds one graph and one block, both of bounded size, and no
graph is shuffled.

How wide the beam is, is found out: a bounded sample of the queries is compared with all rows, and the beam doubled
until at least `recall` of their true neighbours are found. A shard that isn't several times larger than the beam is
compared whole, so the search ends with an exact one at worst.

Defined results: vectors that are null, empty, zero or have a null or non-finite component take no part, as queries or
candidates, nor do rows without vec_id; vectors of different lengths don't meet; a row is left out of its own list by
its vec_id, so rows of one vec_id are one vector (the least in the order of arrays, if they differ); with fewer than k
candidates all are returned; ties go to the smaller vec_id; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, saved, shared_dir, ship
from .vectors import exact_type, matrix, usable


def _distances(points: np.ndarray, norms: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its row of ids, less the query's own norm."""
    return norms[ids] - 2 * np.matmul(points[ids], queries[:, :, None])[:, :, 0]


class Graph:
    def __init__(self, points: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 3):
        self.points = np.ascontiguousarray(points, np.float32)
        self.norms = (self.points * self.points).sum(axis=1)
        self.degree, self.beam, self.alpha2 = degree, beam, alpha * alpha
        n = len(points)
        self.edges = np.full((n, degree), -1, np.int32)
        rng = np.random.default_rng(seed)
        self.starts = np.zeros(0, np.int64)
        if n:
            centre = self.points.mean(axis=0)
            medoid = int(np.argmin(self.norms - 2 * self.points @ centre))
            order = rng.permutation(n)
            order = np.concatenate([[medoid], order[order != medoid]])
            self.starts = order[:8]
            self._build(order)

    def _build(self, order: np.ndarray) -> None:
        n, done = len(order), min(len(order), self.degree)
        first = order[:done]
        for i, p in enumerate(first):
            others = np.delete(first, i)[: self.degree]
            self.edges[p, : len(others)] = others
        while done < n:
            batch = order[done : done + min(512, done, n - done)]
            _, _, met, far = self.search(self.points[batch], self.beam, met=True)
            self._link(batch, met, far)
            done += len(batch)

    def _link(self, batch: np.ndarray, cand: np.ndarray, dist: np.ndarray) -> None:
        dist = np.where(cand == batch[:, None], np.inf, dist + self.norms[batch][:, None])
        kept = self.prune(batch, np.where(np.isinf(dist), -1, cand))
        self.edges[batch] = kept
        # edges back
        src = np.repeat(batch, kept.shape[1])
        dst = kept.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        node, at, count = np.unique(dst, return_index=True, return_counts=True)
        have = (self.edges[node] >= 0).sum(axis=1)
        room = have + count <= self.degree
        slot = np.arange(len(dst)) - np.repeat(at, count) + np.repeat(have, count)
        fits = np.repeat(room, count)
        self.edges[dst[fits], slot[fits]] = src[fits]
        full = np.flatnonzero(~room)
        full = full[np.argsort(count[full], kind="stable")]
        for k in range(0, len(full), 128):
            some = full[k : k + 128]
            wide = int(count[some].max())
            new = np.full((len(some), self.degree + wide), -1, np.int64)
            new[:, : self.degree] = self.edges[node[some]]
            for r, i in enumerate(some):
                new[r, self.degree : self.degree + count[i]] = src[at[i] : at[i] + count[i]]
            self.edges[node[some]] = self.prune(node[some], new)

    def prune(self, who: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """At most `degree` of each row's candidates (-1: none): nearest first, without those that a kept one covers."""
        out = np.full((len(who), self.degree), -1, np.int32)
        for k in range(0, len(who), 128):
            w, c = who[k : k + 128], cand[k : k + 128]
            d = np.where(c >= 0, _distances(self.points, self.norms, self.points[w], np.maximum(c, 0)) + self.norms[w][:, None], np.inf)
            d = np.where(c == w[:, None], np.inf, d)
            o = np.argsort(d, axis=1, kind="stable")[:, : 4 * self.degree]
            rows = np.arange(len(w))[:, None]
            c, d = np.maximum(c[rows, o], 0), d[rows, o]
            x = self.points[c]
            nn = self.norms[c]
            between = nn[:, :, None] + nn[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
            alive = np.isfinite(d)
            r = np.arange(len(w))
            for j in range(self.degree):
                some = alive.any(axis=1)
                if not some.any():
                    break
                best = alive.argmax(axis=1)
                out[k + r[some], j] = c[r[some], best[some]]
                alive &= ~(some[:, None] & (self.alpha2 * between[r, best] <= d + 1e-12))
                alive[r, best] = False
        return out

    def search(self, queries: np.ndarray, beam: int, wide: int = 4, met: bool = False):
        """ids and squared distances (less the query's norm) of the beam, nearest first; and all points met, if asked for."""
        q = np.ascontiguousarray(queries, np.float32)
        b, n = len(q), len(self.points)
        rows = np.arange(b)[:, None]
        ids = np.tile(self.starts, (b, 1))
        dist = _distances(self.points, self.norms, q, ids)
        seen = np.zeros((b, n + 1), bool)
        seen[rows, ids] = True
        seen[:, n] = True  # the place of missing edges
        fresh = np.ones(ids.shape, bool)
        all_i, all_d = [ids], [dist]
        while True:
            # the nearest unexpanded ones of each beam
            d = np.where(fresh, dist, np.inf)
            pick = np.argpartition(d, min(wide, d.shape[1]) - 1, axis=1)[:, :wide] if d.shape[1] > wide else np.tile(np.arange(d.shape[1]), (b, 1))
            real = np.isfinite(d[rows, pick])
            if not real.any():
                break
            nodes = ids[rows, pick]
            fresh[rows, pick] = False
            near = self.edges[nodes].astype(np.int64)
            near = np.where((near >= 0) & real[:, :, None], near, n).reshape(b, -1)
            new = ~seen[rows, near]
            near = np.where(new, near, n)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            width = int((near < n).sum(axis=1).max())
            if not width:
                continue
            near.sort(axis=1)
            near = near[:, :width]
            seen[rows, near] = True
            nd = np.where(near < n, _distances(self.points, self.norms, q, np.minimum(near, n - 1)), np.inf)
            if met:
                all_i.append(np.where(near < n, near, -1))
                all_d.append(nd)
            ids, dist, fresh = np.concatenate([ids, near], axis=1), np.concatenate([dist, nd], axis=1), np.concatenate([fresh, near < n], axis=1)
            if ids.shape[1] > beam:
                o = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, fresh = ids[rows, o], dist[rows, o], fresh[rows, o]
        o = np.argsort(dist, axis=1, kind="stable")
        ids, dist = ids[rows, o], dist[rows, o]
        ids = np.where(np.isfinite(dist), ids, -1)
        if not met:
            return ids, dist
        mi, md = np.concatenate(all_i, axis=1), np.concatenate(all_d, axis=1)
        most = 4 * self.degree
        if mi.shape[1] > most:
            o = np.argpartition(md, most - 1, axis=1)[:, :most]
            mi, md = mi[rows, o], md[rows, o]
        return ids, dist, mi, md


_GRAPH = "shard long, n int, dim int, points binary, edges binary, starts binary, members array<array<long>>"
_HIT = "query_id long, vec_id long, score double"


@dataclass
class Index:
    """A folder of graphs, and the shards of each length of vector (dim, shards), a row for each length."""

    path: str
    shards: DataFrame


def _one_each(vectors: DataFrame) -> DataFrame:
    return usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def build(vectors: DataFrame, k: int = 10, shard_rows: int = 8192, degree: int = 32, beam: int = 64, alpha: float = 1.2) -> Index:
    """The index, saved in the shared folder."""
    spark = vectors.sparkSession
    ship(spark)
    kind = exact_type(vectors)
    rows = _one_each(vectors).select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    # the k + 1 smallest ids of each distinct vector; the limit is applied before the shuffle as well
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    reps = rows.withColumn("nth", rank).where(F.col("nth") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    reps = saved(reps.withColumn("dim", F.size("embedding")), "vectors")
    shards = max(1, -(-reps.count() // shard_rows))
    reps = reps.withColumn("shard", F.col("dim").cast("long") * shards + F.pmod(F.xxhash64(F.element_at("members", 1)), F.lit(shards)))

    def make(d: pd.DataFrame) -> pd.DataFrame:
        x = matrix(d.embedding, np.float64)
        order = np.argsort([m[0] for m in d.members], kind="stable")
        x, members = x[order], [d.members.iloc[i] for i in order]
        g = Graph(x, degree, beam, alpha)
        return pd.DataFrame([(int(d.shard.iloc[0]), len(x), x.shape[1], x.tobytes(), g.edges.tobytes(), g.starts.astype(np.int64).tobytes(), members)], columns=[c.split()[0] for c in _GRAPH.split(", ")])

    path = shared_dir(spark, "graphs")
    reps.groupBy("shard").applyInPandas(make, _GRAPH).write.partitionBy("shard").parquet(path)
    return Index(path, saved(reps.groupBy("dim").agg(F.sort_array(F.collect_set("shard")).alias("shards")), "shards"))


def _load(fs, folder: str, shard: int):
    """One shard's rows (double), graph and the ids of its points."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pf

    at = f"{folder}/shard={shard}"
    name = next(i.path for i in fs.get_file_info(pf.FileSelector(at)) if i.path.endswith(".parquet"))
    with fs.open_input_file(name) as f:
        r = pq.ParquetFile(f).read().to_pylist()[0]
    x = np.frombuffer(r["points"], np.float64).reshape(r["n"], r["dim"])
    g = Graph(np.zeros((0, r["dim"])))
    g.points = x.astype(np.float32)
    g.norms = (g.points * g.points).sum(axis=1)
    g.edges = np.frombuffer(r["edges"], np.int32).reshape(r["n"], -1)
    g.starts = np.frombuffer(r["starts"], np.int64)
    return x, g, r["members"]


def euclid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of x from y, summed component by component."""
    d = x - y
    return np.sqrt(np.cumsum(d * d, axis=1)[:, -1]) if d.shape[1] else np.zeros(len(d))


def search(index: Index, queries: DataFrame, k: int = 10, beam: int = 96, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of `queries` (vec_id, embedding)."""
    spark = queries.sparkSession
    ship(spark)
    path = index.path
    asked = saved(_one_each(queries).withColumn("dim", F.size("embedding")), "queries")
    blocks = max(1, -(-asked.count() // block))
    # runs of shards: a few tasks for each core, whatever the number of blocks
    runs = max(1, 2 * spark.sparkContext.defaultParallelism // blocks)
    run = lambda s: F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.filter(s, lambda x, i: i % runs == r))
    wanted = index.shards.select("dim", F.explode(run(F.col("shards"))).alias("shards")).where("size(shards) > 0")
    pairs = asked.join(wanted, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))

    def find(d: pd.DataFrame) -> pd.DataFrame:
        fs, folder = filesystem(path)
        y, ids = matrix(d.embedding), d.vec_id.to_numpy()
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        for shard in d.shards.iloc[0]:
            x, g, members = _load(fs, folder, int(shard))
            for at in range(0, len(y), 512):
                q = y[at : at + 512]
                if len(x) <= 4 * beam:
                    found = np.tile(np.arange(len(x)), (len(q), 1))
                else:
                    found, _ = g.search(q, beam)
                for i, near in enumerate(found):
                    near = near[near >= 0]
                    score = euclid(x[near], q[i])
                    o = np.argsort(score, kind="stable")[: k + 1]
                    o = np.flatnonzero(score <= score[o[-1]]) if len(o) else o
                    own = [(score[j], m) for j in o for m in members[near[j]] if m != ids[at + i]]
                    best[at + i] = sorted(best[at + i] + own)[:k]
        out = [(i, m, s) for i, own in zip(ids, best) for s, m in own]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    hits = pairs.groupBy("dim", "block", "shards").applyInPandas(find, _HIT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: DataFrame, some: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of the true k nearest of a bounded number of rows `some`, over all rows."""
    own = some.toPandas()
    y, ids = matrix(own.embedding) if own.embedding.str.len().nunique() <= 1 else [np.asarray(e) for e in own.embedding], own.vec_id.to_numpy()

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for dim, g in d.groupby(d.embedding.str.len()):
                x, v = matrix(g.embedding), g.vec_id.to_numpy()
                for q, i in zip(y, ids):
                    if len(q) != dim:
                        continue
                    s = euclid(x, q)
                    s[v == i] = np.inf
                    o = np.lexsort((v, s))[:k]
                    o = o[np.isfinite(s[o])]
                    yield pd.DataFrame({"query_id": i, "vec_id": v[o], "score": s[o]})

    true = _one_each(vectors).mapInPandas(nearest, _HIT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return true.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def recall(index: Index, vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = 200, **options) -> float:
    """Share of the true k nearest that the search finds for a bounded sample of the queries."""
    some = saved(_one_each(queries).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample), "sample")
    return _share(saved(brute_force(vectors, some, k), "true"), search(index, some, k, **options))


def _share(true: DataFrame, found: DataFrame) -> float:
    """The share of the true neighbours that were found, or others exactly as near."""
    far = true.groupBy("query_id").agg(F.max("score").alias("last"), F.count("*").alias("n"))
    hit = found.join(far, "query_id").where("score <= last").groupBy("query_id", "n").count()
    got = far.join(hit.select("query_id", F.least("count", "n").alias("hit")), "query_id", "left").agg(F.sum("hit"), F.sum("n")).head()
    return (got[0] or 0) / got[1] if got[1] else 1.0


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, beam: int = 96, least_recall: float = 0.97, sample: int = 200, **options) -> DataFrame:
    """Build the index over `vectors` and search it with a beam so wide that a sample of the queries finds `least_recall` of its true neighbours."""
    index = build(vectors, k, **options)
    some = saved(_one_each(queries).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample), "sample")
    true = saved(brute_force(vectors, some, k), "true")
    largest = options.get("shard_rows", 8192)
    while 4 * beam < 2 * largest and _share(true, search(index, some, k, beam)) < least_recall:
        beam *= 2
    return search(index, queries, k, beam)
