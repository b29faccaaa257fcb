"""WARC archives: a writer of gzip members with revisit records, and a splittable reader.

The writer makes one file per partition, each record a gzip member of its own. Records of equal payloads (of at least
`least_bytes`) are told by SHA-1: the one with the smallest id is a response, the others are revisits that refer to it
and hold its HTTP header without the payload.

The reader cuts every file into byte ranges. A task scans its range for the gzip magic, takes a candidate for a member
only if its first bytes decode to a WARC header, and owns the records that start in its range, reading on beyond its
end for the last of them. So a file of any size is read by many tasks without an index. A candidate inside compressed
data fails to decode; where a member is known to begin, the scan goes on behind its end, so that a gzip file inside a
payload that is stored uncompressed isn't taken for a record unless the range begins inside that very member; such a
candidate has to decode to a WARC header of its own to be taken.

Defined results: a null payload counts as empty (null url: empty); equal payloads of rows with equal ids: one row of
the smallest id is the response, the others revisit it; a null id comes after all others; an empty table gives no
files and no rows; other columns aren't read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, saved, shared_dir, ship

MAGIC = b"\x1f\x8b\x08"
_ID = re.compile(r"<urn:page:(-?\d+|none)>")
RECORD = "file string, offset long, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    name = lambda x: f"<urn:page:{'none' if x is None else x}>"
    url = re.sub(r"[\r\n]", "", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if payload is not None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {url}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archive `pages` (page_id, url, html) in files under `path`, a URI of a shared folder."""
    ship(pages.sparkSession)
    size, sha = F.octet_length("html"), F.unhex(F.sha1(F.col("html").cast("binary")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keys = saved(rows.select("page_id", sha.alias("sha"), size.alias("size")), "digests")
    if keys.groupBy("page_id", "sha").count().where("count > 1").limit(1).count():
        # equal rows can be told only by their place, which has to be written down for that
        rows = saved(rows.withColumn("at", F.monotonically_increasing_id()), "rows")
        keys = rows.select("page_id", sha.alias("sha"), size.alias("size"), "at")
    else:
        rows, keys = rows.withColumn("at", F.lit(0)), keys.withColumn("at", F.lit(0))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "at")
    first = keys.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    marks = keys.where(F.col("size") >= least_bytes).join(first, "sha").where(~(F.col("first.page_id").eqNullSafe(F.col("page_id")) & (F.col("first.at") == F.col("at")))).select(F.col("page_id").alias("m_id"), F.col("sha").alias("m_sha"), F.col("at").alias("m_at"), F.col("first.page_id").alias("refers_to"), F.lit(True).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, n = None, 0
        for b in batches:
            for page_id, url, html, revisit, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "revisit", "refers_to"))):
                if out is None:
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                data = html.encode()
                if revisit:
                    out.write(record("revisit", page_id, url, None, len(data), digest32(data), refers))
                else:
                    out.write(record("response", page_id, url, data, len(data), digest32(data), None))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "records"])

    marked = rows.withColumn("sha", sha).join(marks, F.col("page_id").eqNullSafe(F.col("m_id")) & (F.col("sha") == F.col("m_sha")) & (F.col("at") == F.col("m_at")), "left")
    done = marked.select("page_id", "url", "html", F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to").mapInArrow(write, "file string, records long")
    # only files of tasks that ended well are listed
    done.write.parquet(f"{path}/manifest")


def member_start(data: bytes, at: int) -> bool:
    """Whether a gzip member whose content begins as a WARC record lies at `at`."""
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 512], 64).startswith(b"WARC/")
    except zlib.error:
        return False


class _Window:
    """Bytes of a file from `at` on, read in blocks."""

    def __init__(self, f, at: int, block: int = 1 << 20):
        self.f, self.block, self.base, self.data = f, block, at, b""
        f.seek(at)

    def more(self) -> bool:
        got = self.f.read(self.block)
        self.data += got
        return bool(got)

    def drop(self, upto: int) -> None:
        self.data = self.data[upto - self.base :]
        self.base = upto


def members(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the WARC records whose gzip member starts in [start, end) of an open file."""
    w = _Window(f, start)
    at = start
    while at < end:
        k = w.data.find(MAGIC, at - w.base)
        if k < 0:
            w.drop(max(at, w.base + len(w.data) - 2))
            at = w.base
            if not w.more():
                return
            continue
        at = w.base + k
        if at >= end:
            return
        while len(w.data) - (at - w.base) < 512 and w.more():
            pass
        if not member_start(w.data, at - w.base):
            at += 1
            continue
        d, parts, pos = zlib.decompressobj(31), [], at - w.base
        try:
            while not d.eof:
                piece = w.data[pos : pos + w.block]
                if not piece and not w.more():
                    raise EOFError(f"the record at {at} is cut off")
                pos += len(piece)
                parts.append(d.decompress(piece))
                if pos > w.block:
                    cut = w.base + pos
                    w.drop(cut)
                    pos = 0
        except zlib.error:  # no member after all: only possible where the scan began inside one
            f.seek(at + 1)
            w = _Window(f, at + 1)
            at += 1
            continue
        yield at, b"".join(parts)
        stop = w.base + pos - len(d.unused_data)
        if stop < w.base:
            w = _Window(f, stop)
        at = stop


def parse(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC header fields (lower-case names), HTTP header and payload of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(x.split(":", 1) for x in head.decode().split("\r\n")[1:] if ":" in x)
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    return fields, http, payload


def read_warc(spark: SparkSession, path: str, split_bytes: int = 8 << 20, payload: bool = False) -> DataFrame:
    """file, offset, record_type, page_id, refers_to, url, payload_bytes, payload_digest and, if asked for, payload (null for revisits).

    Payload sizes and digests are those of the bytes read, for revisits those that the record states.
    """
    ship(spark)
    listed = spark.read.schema("file string, records long").parquet(f"{path}/manifest").select("file")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for b in batches:
            for name in b.column("file").to_pylist():
                size = fs.get_file_info(f"{folder}/{name}").size
                starts = list(range(0, size, split_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(starts)), pa.array(starts, pa.int64()), pa.array([min(size, s + split_bytes) for s in starts], pa.int64())], names=["file", "first", "last"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * payload
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payload

        def number(x: str | None) -> int | None:
            m = _ID.fullmatch(x or "")
            return None if m is None or m[1] == "none" else int(m[1])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows, held = [], 0
        for b in batches:
            for name, start, end in zip(*(b.column(c).to_pylist() for c in ("file", "first", "last"))):
                with fs.open_input_file(f"{folder}/{name}") as f:
                    for at, content in members(f, start, end):
                        fields, http, data = parse(content)
                        kind = fields.get("warc-type", "")
                        if kind == "revisit":
                            size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                            n, digest, data = int(size[1]) if size else None, fields.get("warc-payload-digest", "").removeprefix("sha1:"), None
                        else:
                            n, digest = len(data), digest32(data)
                            if fields.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
                                raise ValueError(f"{name} at {at}: the payload isn't that of its digest")
                        rows.append((name, at, kind, number(fields.get("warc-record-id")), number(fields.get("warc-refers-to")), fields.get("warc-target-uri"), n, digest, *[data] * payload))
                        held += len(content) * payload + 200
                        if held > 1 << 22:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    cut = saved(listed.mapInArrow(ranges, "file string, first long, last long"), "ranges")
    n = max(1, cut.count())
    return cut.repartition(n, "file", "first").mapInArrow(read, RECORD + ", payload binary" * payload)


def archive(pages: DataFrame, least_bytes: int = 0, **options) -> DataFrame:
    """Write archives to the shared folder and read them back."""
    path = shared_dir(pages.sparkSession, "warc")
    write_warc(pages, path, least_bytes)
    return read_warc(pages.sparkSession, path, **options)
