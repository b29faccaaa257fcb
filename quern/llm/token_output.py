"""Token-id output: whole documents encoded and written as Parquet list columns, in ascending doc_id order.

A file set is a folder of Parquet files and a manifest. Each file holds `doc_id`, `n_tokens`, `local_start` (ids
before the document in its file) and `tokens` (a list column), by ascending doc_id; files follow one another in that
order. Row groups end after `group_tokens` ids, `tokens` is dictionary or delta encoded, the other columns are delta
encoded, and all have page indexes, so that metadata, one document or a range can be read without the other pages.

Plan: a scan of doc_id alone gives quantiles; one pass encodes and gives each document the number of its file; one
shuffle of the packed ids (2 bytes each where the vocabulary allows) brings them there; each task sorts and writes.

Defined results: a null text counts as empty (only the end id); a null doc_id comes first; documents of one doc_id
follow each other, in an order fixed by their text; where one doc_id is so frequent that it spans several quantiles,
its rows are spread over those files; an empty table gives no files and no rows; other columns aren't read, whatever
their names; a text of any length is encoded whole.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, filesystem, ragged, shared_dir, ship, text_buffer

_MANIFEST = "part int, file string, rows long, tokens long, base long, groups int"
_LEAST = -(1 << 63)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each document's ids; ids and their numbers."""
    full = counts + 1
    out = np.empty(len(ids) + len(counts), np.uint32)
    last = np.cumsum(full) - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[last] = end
    out[keep] = ids
    return out, full


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A large_binary array of the runs of `values`."""
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values))])


def _cuts(docs: DataFrame, parts: int) -> np.ndarray:
    """parts - 1 quantiles of doc_id, some of them maybe equal."""
    if parts < 2:
        return np.zeros(0, np.int64)
    at = [i / parts for i in range(1, parts)]
    q = docs.select(F.col("doc_id").cast("double").alias("v")).approxQuantile("v", at, min(0.01, 0.1 / parts))
    return np.array(q, np.float64).astype(np.int64)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, files: int | None = None, group_tokens: int = 1 << 20, page_bytes: int = 1 << 16, encoding: str = "dictionary") -> None:
    """Encode `docs` (doc_id, text) and write a file set at `path`, a URI of a shared folder."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(docs, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import encoder

        e = encoder(vocabulary)
        packed = np.uint16 if e.whole.get_vocab_size() <= 1 << 16 else np.uint32
        for b in chunks(batches, "text"):
            raw, off = text_buffer(b.column("text"))
            ids, n = with_end(*e.encode_batch(raw, off), end_id)
            doc = b.column("doc_id").fill_null(_LEAST).to_numpy(zero_copy_only=False)
            data = _binary(ids.astype(packed), n)
            tie = np.array([zlib.crc32(x) for x in data.to_pylist()], np.int64)
            low, high = np.searchsorted(cuts, doc, "left"), np.searchsorted(cuts, doc, "right")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), data, pa.array(tie), pa.array((low + tie % (high - low + 1)).astype(np.int32))], names=["doc_id", "n", "ids", "tie", "pid"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.parquet"
        kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("local_start", pa.int64()), ("tokens", pa.list_(pa.field("element", pa.int32())))])
        delta = {"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED", "local_start": "DELTA_BINARY_PACKED"}
        options = {"use_dictionary": ["tokens.list.element"], "column_encoding": delta} if encoding == "dictionary" else {"use_dictionary": False, "column_encoding": delta | {"tokens.list.element": "DELTA_BINARY_PACKED"}}
        writer, rows, tokens, held, size, groups = None, 0, 0, [], 0, 0

        def flush() -> None:
            nonlocal writer, rows, tokens, held, size, groups
            if not held:
                return
            if writer is None:
                writer = pq.ParquetWriter(f"{folder}/{name}", kind, filesystem=fs, compression="zstd", write_page_index=True, data_page_size=page_bytes, dictionary_pagesize_limit=1 << 20, **options)
            doc = pa.concat_arrays([h[0] for h in held])
            n = np.concatenate([h[1] for h in held])
            off = np.concatenate([[0], np.cumsum(n)])
            ids = np.concatenate([h[2] for h in held]).astype(np.int32)
            # one list's offsets are 32 bits; group_tokens is far below
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
            writer.write_table(pa.Table.from_arrays([doc, pa.array(n), pa.array(tokens + off[:-1]), lists.cast(kind.field("tokens").type)], schema=kind), row_group_size=max(1, len(n)))
            rows, tokens, groups, held, size = rows + len(n), tokens + int(off[-1]), groups + 1, [], 0

        for b in batches:
            n = b.column("n").to_numpy()
            raw, _ = text_buffer(b.column("ids").cast(pa.large_binary()).view(pa.large_string()))
            ids = raw.view(np.uint16) if len(raw) == 2 * n.sum() else raw.view(np.uint32)
            off = np.concatenate([[0], np.cumsum(n)])
            i = 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(off, off[i] + group_tokens - size, "right")) - 1)
                held.append((b.column("doc_id").slice(i, j - i), n[i:j], ids[off[i] : off[j]].copy()))
                size += int(off[j] - off[i])
                if size >= group_tokens or j < len(n):
                    flush()
                i = j
        flush()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), name, rows, tokens, groups)], names=["part", "file", "rows", "tokens", "groups"])

    done = docs.mapInArrow(encode, "doc_id long, n long, ids binary, tie long, pid int").repartitionById(parts, F.col("pid")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "n").drop("pid", "tie").mapInArrow(write, "part long, file string, rows long, tokens long, groups long")
    base, rows = 0, []
    for r in sorted(done.collect(), key=lambda r: r["part"]):  # a row for each file
        rows.append((r["part"], r["file"], r["rows"], r["tokens"], base, r["groups"]))
        base += r["tokens"]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, tokens: bool = True, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, if asked for, ids (binary, little-endian unsigned 32 bits).

    A task reads one row group. Without `tokens` the list column isn't read. `doc_ids` (first, last) skips row
    groups by their statistics.
    """
    ship(spark)
    groups = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").select("file", "base", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"))
    n = max(1, groups.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        fs, folder = filesystem(path)
        for b in batches:
            for file, base, g in zip(*(b.column(c).to_pylist() for c in ("file", "base", "grp"))):
                with fs.open_input_file(f"{folder}/{file}") as f:
                    p = pq.ParquetFile(f)
                    if doc_ids:
                        s = p.metadata.row_group(g).column(0).statistics
                        if s is not None and s.has_min_max and (s.max < doc_ids[0] or s.min > doc_ids[1]):
                            continue
                    t = p.read_row_group(g, columns=["doc_id", "n_tokens", "local_start", *["tokens"] * tokens], use_threads=False).combine_chunks()
                if doc_ids:
                    v = t["doc_id"]
                    t = t.filter(pa.compute.and_(pa.compute.greater_equal(v, doc_ids[0]), pa.compute.less_equal(v, doc_ids[1]))).combine_chunks()
                if not t.num_rows:
                    continue
                start = base + t["local_start"].to_numpy()
                out = [t["doc_id"].chunk(0), pa.array(start), t["n_tokens"].chunk(0)]
                if tokens:
                    lists = t["tokens"].chunk(0)
                    off = lists.offsets.to_numpy()
                    out.append(_binary(lists.values.to_numpy()[off[0] : off[-1]].astype(np.uint32), np.diff(off)))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", *["ids"] * tokens])

    return groups.withColumn("_to", (F.row_number().over(_any_window()) - 1).cast("int")).repartitionById(n, F.col("_to")).drop("_to").mapInArrow(read, "doc_id long, start long, n_tokens long" + ", ids binary" * tokens)


def _any_window():
    from pyspark.sql import Window

    return Window.orderBy("base", "grp")  # over the manifest's row groups alone, a few bytes each


def with_crc(df: DataFrame) -> DataFrame:
    """ids replaced by ids_crc32, their unsigned crc32."""
    return df.withColumn("ids_crc32", F.crc32(F.col("ids"))).drop("ids")


def token_output(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write a file set to the shared folder and read it back: doc_id, start, n_tokens, ids_crc32."""
    path = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, **options)
    return with_crc(read_tokens(docs.sparkSession, path))
