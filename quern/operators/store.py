"""A mutable document store on immutable Parquet: an operation log with one manifest for each batch.

A batch is written to `ops/batch=<id>` and then made visible by renaming a small JSON file into `_manifests/`; a batch
without a manifest is pending and no reader sees it. The live view is the last operation of each document, if it isn't
a deletion. Recovery adopts a pending batch whose rows are all whole and whose number was written beside it, and
discards others. `compact` writes the live view as a new base and moves the `CURRENT` pointer to it.

Files go through pyarrow's file systems, so a store can lie wherever the executors can write.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPS = "seq long, op string, doc_id string, doc_json string"


def last_ops(ops: DataFrame) -> DataFrame:
    """The last operation of each document. max_by needs one partial aggregate, no sort."""
    rest = [c for c in ops.columns if c not in ("doc_id", "seq")]
    return ops.groupBy("doc_id").agg(F.max_by(F.struct("seq", *rest), "seq").alias("r")).select("doc_id", "r.seq", *[f"r.{c}" for c in rest])


def live(ops: DataFrame) -> DataFrame:
    """Documents whose last operation isn't a deletion."""
    return last_ops(ops).where("op <> 'delete'")


def byte_offsets(records: DataFrame, order: str = "seq", record: str = "record") -> DataFrame:
    """Where each record would begin in one file of lines: a running sum in two steps, over parts of the order and
    then within each, so that no task gets the whole table."""
    size = F.octet_length(record) + 1
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = records.withColumn("size", size.cast("long")).repartitionByRange(n, order).withColumn("part", F.spark_partition_id())
    sums = parted.groupBy("part").agg(F.sum("size").alias("part_bytes"))  # a row for each partition
    before = sums.withColumn("base", F.coalesce(F.sum("part_bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("part_bytes")
    own = F.sum("size").over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return parted.withColumn("own", F.coalesce(own, F.lit(0))).join(F.broadcast(before), "part").withColumn("byte_offset", F.col("base") + F.col("own")).drop("part", "base", "own")


def replay(log: DataFrame) -> DataFrame:
    """Operations that count after a crash, from log records (seq, op, doc_id, segment, byte_offset, status, record):
    committed ones, and pending ones without a commit of the same place whose record is whole and of the same id."""
    done = log.where("status = 'committed'")
    pending = log.where("status = 'pending'").join(done.select("segment", "byte_offset"), ["segment", "byte_offset"], "left_anti")
    whole = pending.where(F.get_json_object("record", "$.id") == F.col("doc_id")).where(F.try_parse_json("record").isNotNull())
    # all committed operations come before the recovered ones
    return done.withColumn("pass", F.lit(1)).unionByName(whole.withColumn("pass", F.lit(2)))


def read_log(lines: DataFrame, schema: str) -> DataFrame:
    """Log records from lines of JSON; malformed ones are skipped wherever they stand."""
    return lines.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("r")).select("r.*")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        from pyarrow import fs

        self.spark = spark
        self.path = path if ":" in path else f"file://{path}"
        self.fs, self.root = fs.FileSystem.from_uri(self.path)
        self.fs.create_dir(f"{self.root}/_manifests", recursive=True)

    # small files

    def _read(self, name: str) -> dict | None:
        from pyarrow import fs

        if self.fs.get_file_info(f"{self.root}/{name}").type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return json.loads(f.read())

    def _write(self, name: str, value: dict) -> None:
        """Whole or not at all: written beside and renamed."""
        at = f"{self.root}/_tmp-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(at) as f:
            f.write(json.dumps(value).encode())
        self.fs.move(at, f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        from pyarrow import fs

        return sorted(i.base_name for i in self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True)))

    def manifests(self) -> list[dict]:
        return [m for n in self._names("_manifests") if (m := self._read(f"_manifests/{n}"))]

    # writing

    def stage(self, ops: DataFrame, batch: str) -> dict:
        """Write a batch (op, doc_id, doc_json) without making it visible."""
        first = max([m["first"] + m["rows"] for m in self.manifests()] + [(self._read("CURRENT") or {}).get("next", 0)], default=0)
        at = f"{self.path}/ops/batch={batch}"
        # numbers in the order of the rows: partition by partition
        numbered = ops.select("op", F.col("doc_id").cast("string").alias("doc_id"), "doc_json", F.monotonically_increasing_id().alias("seq"))
        numbered.select((F.col("seq") + F.lit(first)).alias("seq"), "op", "doc_id", "doc_json").write.mode("overwrite").parquet(at)
        n, top = self.spark.read.schema(OPS).parquet(at).agg(F.count("*"), F.max("seq")).head()
        note = {"batch": batch, "first": first, "rows": (top - first + 1) if n else 0, "ops": n, "at": time.time()}
        self._write(f"ops/batch={batch}/_rows", note)
        return note

    def commit(self, note: dict) -> None:
        self._write(f"_manifests/{note['batch']}.json", note)

    def append(self, ops: DataFrame, batch: str | None = None) -> str:
        """Write and commit. A batch id that is committed already is left as it is, so a retried batch counts once."""
        batch = batch or uuid.uuid4().hex
        if self._read(f"_manifests/{batch}.json") is None:
            self.commit(self.stage(ops, batch))
        return batch

    def add(self, docs: DataFrame, batch: str | None = None) -> str:
        """Add or replace documents (doc_id, doc_json); a null doc_id gets a new one."""
        return self.append(docs.select(F.lit("write").alias("op"), F.coalesce(F.col("doc_id").cast("string"), F.uuid()).alias("doc_id"), "doc_json"), batch)

    def delete(self, ids: DataFrame, batch: str | None = None) -> int:
        """Delete the live ones of `ids` (doc_id); how many there were."""
        gone = self.live().join(ids.select(F.col("doc_id").cast("string")).distinct(), "doc_id", "left_semi").select("doc_id")
        batch = self.append(gone.select(F.lit("delete").alias("op"), "doc_id", F.lit(None).cast("string").alias("doc_json")), batch)
        return self._read(f"_manifests/{batch}.json")["ops"]

    # reading

    def ops(self) -> DataFrame:
        current = self._read("CURRENT") or {}
        parts = [f"{self.path}/ops/batch={m['batch']}" for m in self.manifests() if m["ops"]]
        if current.get("base"):
            parts.append(f"{self.path}/{current['base']}")
        return self.spark.read.schema(OPS).parquet(*parts) if parts else self.spark.createDataFrame([], OPS)

    def live(self) -> DataFrame:
        """seq, doc_id, doc_json of the documents that are there."""
        return live(self.ops()).select("seq", "doc_id", "doc_json")

    def get(self, doc_id: str) -> dict | None:
        """One document; the id's operations alone are read, by pushed-down filter."""
        row = live(self.ops().where(F.col("doc_id") == str(doc_id))).select("doc_json").head()
        return None if row is None else json.loads(row[0])

    def list(self, offset: int = 0, limit: int = 50) -> DataFrame:
        return self.live().orderBy("seq").offset(offset).limit(limit)

    def count(self) -> int:
        return self.live().count()

    # upkeep

    def recover(self) -> dict[str, int]:
        """Adopt whole pending batches, discard others."""
        known = {m["batch"] for m in self.manifests()}
        done = set((self._read("CURRENT") or {}).get("merged", []))
        out = {"adopted": 0, "discarded": 0}
        for name in self._names("ops"):
            batch = name.removeprefix("batch=")
            if batch in known or batch in done:
                continue
            note, whole = self._read(f"ops/{name}/_rows"), False
            if note is not None:
                try:
                    rows = self.spark.read.schema(OPS).parquet(f"{self.path}/ops/{name}")
                    whole = rows.where("op = 'delete' or try_parse_json(doc_json) is not null").count() == note["ops"]
                except Exception as e:  # noqa: BLE001 a torn Parquet file, whatever it breaks
                    whole = False
                    out.setdefault("errors", []).append(str(e)[:200])
            if whole:
                self.commit(note)
                out["adopted"] += 1
            else:
                self.fs.delete_dir(f"{self.root}/ops/{name}")
                out["discarded"] += 1
        return out

    def compact(self) -> int:
        """Rewrite the live view as the base; superseded batches are removed after the pointer has moved."""
        merged = self.manifests()
        base = f"base-{uuid.uuid4().hex}"
        self.live().select("seq", F.lit("write").alias("op"), "doc_id", "doc_json").repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{self.path}/{base}")
        old = self._read("CURRENT") or {}
        following = max([m["first"] + m["rows"] for m in merged] + [old.get("next", 0)])
        names = [m["batch"] for m in merged]
        self._write("CURRENT", {"base": base, "next": following, "merged": names})
        for b in names:
            self.fs.delete_file(f"{self.root}/_manifests/{b}.json")
            self.fs.delete_dir(f"{self.root}/ops/batch={b}")
        if old.get("base"):
            self.fs.delete_dir(f"{self.root}/{old['base']}")
        return self.count()

    def reset(self) -> None:
        """Remove all documents; the store stays usable and stays empty after a restart."""
        self.fs.delete_dir_contents(self.root)
        self.fs.create_dir(f"{self.root}/_manifests", recursive=True)
