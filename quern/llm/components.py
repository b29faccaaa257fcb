"""Connected components of an edge table, without bringing a component into one task.

Each partition first contracts its own edges to stars. While more than `small` edges are left, rounds of large-star and
small-star (Kiveris et al., "Connected components in MapReduce and beyond", 2014) run as joins; below that bound, a
single task ends the work: its input is at most `small` rows of two longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and, for each, the smallest node that it is connected to."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        m = np.minimum(x, y)
        if (x == y).all():
            return nodes, nodes[label]
        np.minimum.at(label, x, m)
        np.minimum.at(label, y, m)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = [(u, v)]
    size = 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        n, r = roots(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        keep = n != r
        return n[keep], r[keep]

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size > 1 << 20:
            held = [fold()]
            size = len(held[0][0])
    n, r = fold()
    for i in range(0, len(n), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(n[i : i + (1 << 16)]), pa.array(r[i : i + (1 << 16)])], names=["u", "v"])


def components(edges: DataFrame, small: int = 1_000_000) -> DataFrame:
    """node, root (the smallest node of its component) of every node in `edges` (two long columns), saved."""
    ship(edges.sparkSession)
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v")
    e = saved(e.mapInArrow(_contract, "u long, v long"), "stars")
    before = None
    while True:
        n, mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if n <= small:
            return saved(_with_roots(e.coalesce(1).mapInArrow(_contract, "u long, v long")), "components")
        if (n, mark) == before:
            return saved(_with_roots(e), "components")
        before = n, mark
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = saved(large, "stars")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        e = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = saved(e, "stars")


def _with_roots(stars: DataFrame) -> DataFrame:
    own = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own)
