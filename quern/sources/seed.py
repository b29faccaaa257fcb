"""A deterministic synthetic corpus, for benchmarks and tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..plans.shared import ship

_FRONT = "storage index search database system engine document query ranking segment offset durability crash recovery"
_MIDDLE = "inverted posting tokenizer stopword relevance score distributed log append snapshot compaction tombstone"
_THEN = "latency throughput benchmark cache memory disk seek write read delete update consistency replication shard"
_BACK = "partition cluster node network protocol serialize buffer stream flush fsync corruption integrity checksum vector"
WORDS = " ".join((_FRONT, _MIDDLE, _THEN, _BACK)).split()
TITLES = [t.replace("_", " ") for t in "Notes_on A_study_of Understanding Deep_dive_into Practical Rethinking Scaling Debugging Optimizing Introduction_to".split()]
_A, _C, _M = 1664525, 1013904223, 1 << 32


class Generator:
    """A linear congruential generator; `skip` jumps over any number of draws."""

    def __init__(self, state: int = 42):
        self.state = state % _M

    def draw(self) -> float:
        self.state = (self.state * _A + _C) % _M
        return self.state / (_M - 1)

    def skip(self, n: int) -> None:
        a, c, fa, fc = _A, _C, 1, 0
        while n:
            if n & 1:
                fa, fc = fa * a % _M, (fc * a + c) % _M
            a, c, n = a * a % _M, (c * a + c) % _M, n >> 1
        self.state = (self.state * fa + fc) % _M

    def word(self) -> str:
        return WORDS[min(int(math.floor(math.pow(self.draw(), 2.2) * len(WORDS))), len(WORDS) - 1)]

    def document(self, i: int) -> tuple[str, str, int]:
        body = [self.word() for _ in range(20 + int(math.floor(self.draw() * 180)))]
        return f"{TITLES[i % len(TITLES)]} {self.word()} {self.word()}", " ".join(body), i


def corpus(spark: SparkSession, count: int, seed: int = 42, block: int = 5000) -> DataFrame:
    """title, body, seq. How many draws a document takes depends on its first, so the driver runs through the lengths
    alone (by jumps) and notes the state at each block; the texts are made by the executors."""
    ship(spark)
    g, states = Generator(seed), []
    for i in range(count):
        if i % block == 0:
            states.append((i, min(count, i + block), g.state))
        g.skip(20 + int(math.floor(g.draw() * 180)) + 2)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for first, last, state in d.itertuples(index=False):
                own = Generator(int(state))
                yield pd.DataFrame([own.document(i) for i in range(first, last)], columns=["title", "body", "seq"])

    if not states:
        return spark.createDataFrame([], "title string, body string, seq long")
    return spark.createDataFrame(states, "first long, last long, state long").repartition(len(states)).mapInPandas(make, "title string, body string, seq long")
