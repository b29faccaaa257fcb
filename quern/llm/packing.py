"""Packing of token sequences: bounded-space online best fit, then a merge of what stays open.

Each partition keeps at most `windows` open windows. A document's ids (with an end id) are cut into full windows and a
rest; the rest goes to the window that it fills best; where none has room, the fullest is emitted and a new one opened.
The windows still open at the end are merged in a tree: groups of `fan` partitions lay theirs one after another and cut
at `size`, each group passes its one unfilled window on, until one group is left. So no task ever holds more than
`fan` times `windows` windows.

Sequences stand for `size` ids and are padded to that by their reader, except those whose length is a power of two.

Defined results: a null or empty text has one id, the end id; equal rows and equal doc_ids are separate documents;
an empty table gives no rows; other columns aren't read; a text of any length is encoded whole and cut.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, saved, ship, text_buffer
from .token_output import with_end

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OPEN = _PIECE + ", part long, ids binary"
#: Bits of a sequence id below the partition, and the bit that marks merged ones.
_LOCAL, _MERGED = 32, 1 << 62


class Windows:
    """The open windows of one partition."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free: list[tuple[int, int]] = []  # (room, window), ascending
        self.made = 0

    def place(self, n: int) -> tuple[int, int, int | None]:
        """The window and offset for n ids, and the window that was emitted for it, if any."""
        k = bisect.bisect_left(self.free, (n, -1))
        if k < len(self.free):
            room, w = self.free.pop(k)
            at = self.size - room
            emitted = None
        else:
            emitted = self.free.pop(0)[1] if len(self.free) >= self.most else None
            w, at, room = self.new(), 0, self.size
        if room > n:
            bisect.insort(self.free, (room - n, w))
        return w, at, emitted

    def new(self) -> int:
        self.made += 1
        return self.made - 1


def merge(rows: pd.DataFrame, size: int, prefix: int, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Lay windows one after another and cut at `size`: closed pieces, and those of the one window that isn't full."""
    rows = rows.sort_values(["fill", "part", "sequence_id", "offset"], ascending=[False, True, True, True], kind="stable")
    out, seq, at = [], 0, 0
    for r in rows.itertuples(index=False):
        done, ids = 0, r.ids
        while done < r.length:
            n = min(r.length - done, size - at)
            part = ids[4 * done : 4 * (done + n)]
            out.append((r.doc_id, r.start + done, n, zlib.crc32(part), r.doc_tokens, prefix + seq, at, 0, part))
            done, at = done + n, at + n
            if at == size:
                seq, at = seq + 1, 0
    d = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"])
    still = (d.sequence_id == prefix + seq) & (not last)
    return d[~still], d[still]


def _folding(size: int, level: int, last: bool):
    def fold(key, rows):
        rows["fill"] = rows.groupby("sequence_id")["length"].transform("sum")
        shut, still = merge(rows, size, _MERGED | level << 56 | int(key[0]) << 28, last)
        both = pd.concat([shut.assign(closed=True), still.assign(closed=False)])
        both["part"] = int(key[0])
        return both[[*"doc_id start length ids_crc32 doc_tokens sequence_id offset part ids closed".split()]]

    return fold


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, windows: int = 64, fan: int = 32, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves if asked for."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .bpe import encoder

        e, part = encoder(vocabulary), TaskContext.get().partitionId()
        base = part << _LOCAL
        space = Windows(size, windows)
        held: dict[int, list] = {}
        ready: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            kinds = [pa.int64()] * 8 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)] + [pa.array([r[8] is None or with_ids for r in rows])], names=[*"doc_id start length ids_crc32 doc_tokens sequence_id offset part".split(), "ids", "closed"])

        def close(w: int) -> None:
            ready.extend(x if with_ids else (*x[:8], None) for x in held.pop(w))

        for b in chunks(batches, "text"):
            raw, off = text_buffer(b.column("text"))
            ids, n = with_end(*e.encode_batch(raw, off), end_id)
            data, at = ids.tobytes(), 0
            for doc, total in zip(b.column("doc_id").to_pylist(), n.tolist()):
                own = memoryview(data)[4 * at : 4 * (at + total)]
                at += total
                full = total // size * size
                for s in range(0, full, size):
                    x = own[4 * s : 4 * (s + size)]
                    ready.append((doc, s, size, zlib.crc32(x), total, base + space.new(), 0, part, bytes(x) if with_ids else None))
                if total > full:
                    x = own[4 * full :]
                    w, o, emitted = space.place(total - full)
                    held.setdefault(w, []).append((doc, full, total - full, zlib.crc32(x), total, base + w, o, part, bytes(x)))
                    if emitted is not None:
                        close(emitted)
                    if o + total - full == size:
                        close(w)
            if len(ready) >= 4096:
                yield batch(ready)
                ready = []
        if ready:
            yield batch(ready)
        if held:
            rows = [x for w in held.values() for x in w]
            cols = batch(rows)
            yield cols.set_column(cols.num_columns - 1, "closed", pa.array([False] * len(rows)))

    placed = saved(docs.mapInArrow(place, _OPEN + ", closed boolean"), "pack")
    keep = [c.split()[0] for c in _PIECE.split(", ")] + ["ids"] * with_ids
    result = placed.where("closed").select(keep)
    rest = placed.where(~F.col("closed")).drop("closed")
    top = placed.agg(F.max("part")).head()[0]
    level = 0
    groups = 0 if top is None else top + 1
    while groups:
        groups = -(-groups // fan)
        last, level = groups == 1, level + 1

        step = saved(
            rest.withColumns({"part": F.floor(F.col("part") / fan), "doc_id": F.col("doc_id").cast("string")})  # a string: pandas has no null among longs
            .groupBy("part")
            .applyInPandas(_folding(size, level, last), _OPEN.replace("doc_id long", "doc_id string") + ", closed boolean")
            .withColumn("doc_id", F.col("doc_id").cast("long")),
            "pack",
        )
        result = result.unionByName(step.where("closed").select(keep))
        rest = step.where(~F.col("closed")).drop("closed")
        if last:
            break
    return result
