"""Shared plumbing of the training-data operators: the shared folder, shipping, Arrow text batches."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def _give_back() -> None:
    """Let large buffers of Arrow and numpy go back to the system when they are freed: several workers share an executor's memory."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


_give_back()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    at = os.path.join(tempfile.mkdtemp(prefix="ship"), f"{name}_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(at, "w") as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder that all executors share, under spark.checkpoint.dir; one of our own only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="shared")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{os.path.abspath(base)}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    at = shared_dir(spark, label)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def filesystem(uri: str):
    """The pyarrow file system of a folder and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    if not large and not pa.types.is_string(column.type):
        column, large = column.cast(pa.large_string()), True
    kind = np.int64 if large else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that each part has about `most` bytes of text; one row is never cut."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = text_buffer(b.column(column))
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(off, off[i] + most, "right")) - 1
            j = min(max(j, i + 1), b.num_rows)
            yield b.slice(i, j - i)
            i = j


def fold(column: str, mod: int) -> F.Column:
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length of all ranges, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def where_score(docs: DataFrame, keep) -> DataFrame:
    """The rows, with all their columns, for whose text `keep` (a function of buffer and offsets) is true."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            yield b.filter(pa.array(np.asarray(keep(*text_buffer(b.column("text"))), bool)))

    ship(docs.sparkSession)
    return docs.mapInArrow(rows, docs.schema)
