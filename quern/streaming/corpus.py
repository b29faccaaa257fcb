"""Structured Streaming: a folder of line-delimited JSON indexed batch by batch into a store.

Each micro-batch is appended under an id made from the stream and the batch number, so a batch that is retried after a
failure counts once. Progress is kept as one row for each batch.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.docmeta import number_field, trim
from ..operators.store import Store


def documents_of(lines: DataFrame) -> DataFrame:
    """doc_json of lines that hold a JSON value; blank and malformed ones are skipped."""
    own = lines.select(trim(F.col("value")).alias("doc_json"))
    return own.where((F.col("doc_json") != "") & F.try_parse_json("doc_json").isNotNull())


def fresh(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose numeric pageid isn't among `known` (pageid); those without one are always fresh."""
    keyed = docs.withColumn("pageid", number_field(F.col("doc_json"), "pageid").cast("long"))
    return keyed.join(known.select("pageid").where("pageid is not null").distinct(), "pageid", "left_anti").select("doc_json")


def index_stream(spark: SparkSession, store: Store, folder: str, checkpoint: str, source: str | None = None, files_per_batch: int = 1, once: bool = True) -> list[dict]:
    """Read a folder of lines as a stream into the store; the progress of each batch. `source` sets which documents already there are not added again, by pageid."""
    progress: list[dict] = []
    known = by_source(store.live(), source).select("pageid") if source else None

    def add(batch: DataFrame, number: int) -> None:
        docs = documents_of(batch)
        docs = fresh(docs, known) if known is not None else docs
        name = f"stream-{zlib.crc32(checkpoint.encode()):08x}-{number:08d}"
        store.add(docs.select(F.lit(None).cast("string").alias("doc_id"), "doc_json"), name)
        progress.append({"type": "progress", "batch": number, "indexed": sum(m["ops"] for m in store.manifests() if m["batch"].startswith(name[:-8]))})

    stream = spark.readStream.schema("value string").format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
        progress.append({"type": "done", "indexed": progress[-1]["indexed"] if progress else 0, "documents": store.count()})
    return progress


def by_source(live: DataFrame, source: str) -> DataFrame:
    """doc_id and numeric pageid of the live documents of a source."""
    own = live.where(F.get_json_object("doc_json", "$.source") == source)
    return own.select("doc_id", number_field(F.col("doc_json"), "pageid").cast("long").alias("pageid"))


def progress_rows(batches: DataFrame, size: int = 500, order: str = "seq") -> DataFrame:
    """batch, indexed, total: documents added after each batch of `size` in an order; one row for each batch."""
    counted = batches.groupBy(F.floor(F.col(order) / size).alias("batch")).agg(F.count_if("fresh").alias("own"), F.count("*").alias("rows"))
    every = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    return counted.select("batch", F.sum("own").over(every).alias("indexed"), F.sum("rows").over(whole).alias("total"))


def term_counts(lines: DataFrame) -> DataFrame:
    """A streaming aggregate: documents of each term so far, kept in the state store."""
    from ..functions.analysis import json_text, tokenize

    own = documents_of(lines).select(F.explode(F.array_distinct(tokenize(json_text(F.col("doc_json"))))).alias("term"))
    return own.groupBy("term").agg(F.count("*").alias("df"))
