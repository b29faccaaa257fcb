"""Files as documents: a router over `binaryFile` by extension and content.

PDF files go through a small text extractor in an Arrow function; all else is Column expressions: JSON (an object is
one document, an array one for each element), lines of JSON, and text. Each file also gets a line in a report.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.docmeta import TEXT, extension_of, trim
from ..plans.shared import ship

_PDF = "text string, pages int, error string"
EMPTY, BINARY, SCANNED = "empty file", "unsupported binary file (no text to index)", "no extractable text (likely a scanned/image-only PDF)"


def is_binary(content: Column) -> Column:
    """By the first 8192 bytes: a NUL, or more than 0.3 of control characters other than white space."""
    sample = F.substring(content, 1, 8192)
    hexed = F.hex(sample)
    # two digits a byte: control bytes are counted as what goes when they are removed
    spaced = F.regexp_replace(hexed, "(..)", "$1 ")
    nul = F.regexp_count(spaced, F.lit("00 ")) > 0
    control = F.regexp_count(spaced, F.lit("(?:0[0-8]|0[EF]|1[0-9A-F]) "))
    return (F.octet_length(sample) > 0) & (nul | (control / F.octet_length(sample) > 0.3))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """filename (the last path component) and content of all files under a path or glob."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "content")


def pdf_text(data: bytes) -> tuple[str, int]:
    """Text and number of pages of a plain PDF: the strings shown by Tj, ' and TJ in its (Flate) streams."""
    pages = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data))
    out = []
    for m in re.finditer(rb"(<<(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*>>)\s*stream\r?\n(.*?)\r?\n?endstream", data, re.S):
        head, body = m[1], m[2]
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        for block in re.findall(rb"BT(.*?)ET", body, re.S):
            line = []
            for shown in re.finditer(rb"\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(\((?:\\.|[^\\()])*\))\s*(?:Tj|'|\")", block, re.S):
                parts = re.findall(rb"\(((?:\\.|[^\\()])*)\)", shown[1] if shown[1] is not None else shown[2], re.S)
                line.append("".join(_pdf_string(p) for p in parts))
            out.append(" ".join(line))
    return "\n".join(x for x in out if x).strip(), max(pages, 1)


def _pdf_string(raw: bytes) -> str:
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else named.get(m[1], m[1]), raw, flags=re.S).decode("latin-1")


def _read_pdf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        rows = []
        for content in d.content:
            try:
                if not bytes(content[:5]).startswith(b"%PDF"):
                    raise ValueError("Invalid PDF structure.")
                rows.append((*pdf_text(bytes(content)), None))
            except Exception as e:  # noqa: BLE001 the report tells what went wrong with the file
                rows.append((None, None, str(e)))
        yield pd.concat([d[["filename"]].reset_index(drop=True), pd.DataFrame(rows, columns=["text", "pages", "error"])], axis=1)


def with_source(json: Column, filename: Column) -> Column:
    """A JSON value as a document: an object gets the file's name (over its own), any other value is its content."""
    body = F.regexp_extract(json, r"(?s)^\s*\{(.*)\}\s*$", 1)
    name = F.to_json(F.struct(filename.alias("filename")))
    inner = F.regexp_extract(name, r"(?s)^\{(.*)\}$", 1)
    # the last of equal keys counts, so the name goes last
    return F.when(json.rlike(r"^\s*\{"), F.concat(F.lit("{"), F.when(trim(body) == "", "").otherwise(F.concat(body, F.lit(","))), inner, F.lit("}"))).otherwise(F.concat(F.lit("{"), inner, F.lit(',"content":'), json, F.lit("}")))


def documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (filename, nth, doc_json) and a report (filename, status, reason, documents) of files (filename, content)."""
    ship(files.sparkSession)
    ext = extension_of(F.col("filename"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    kind = F.when(ext == "pdf", "pdf").when(~ext.isin(*TEXT) & is_binary(F.col("content")), "binary").when(ext == "json", "json").when(ext.isin("ndjson", "jsonl"), "lines").otherwise("text")
    routed = files.withColumn("kind", kind)
    read = routed.where("kind not in ('pdf', 'binary')").select("filename", "kind", text.alias("text"))
    valid = F.try_parse_json("text")
    parsed = read.withColumn("kind", F.when((F.col("kind") == "json") & valid.isNull(), "text").otherwise(F.col("kind")))
    # each element of an array by its place; a single value as an array of one
    is_array = F.schema_of_variant(F.try_parse_json("text")).startswith("ARRAY")
    elements = F.when(is_array, F.transform(F.try_variant_get(F.try_parse_json("text"), "$", "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array(F.to_json(F.try_parse_json("text"))))
    lines = F.filter(F.transform(F.split("text", "\n"), trim), lambda x: (x != "") & F.try_parse_json(x).isNotNull())
    values = F.when(F.col("kind") == "json", elements).when(F.col("kind") == "lines", lines)
    some = parsed.withColumn("values", values).withColumn("kind", F.when((F.col("kind") == "lines") & (F.size("values") == 0), "text").otherwise(F.col("kind")))
    blank = trim(F.col("text")) == ""
    whole = F.array(F.to_json(F.struct("filename", F.col("text").alias("content"))))
    docs = F.when(F.col("kind").isin("json", "lines"), F.transform("values", lambda v: with_source(v, F.col("filename")))).when(blank, F.array().cast("array<string>")).otherwise(whole)
    status = F.when((F.col("kind") == "text") & blank, "skipped").otherwise("indexed")
    plain = some.select("filename", status.alias("status"), F.when(status == "skipped", EMPTY).alias("reason"), docs.alias("docs"))
    pdf = routed.where("kind = 'pdf'").select("filename", "content").mapInPandas(_read_pdf, f"filename string, {_PDF}")
    reason = F.coalesce("error", F.when(trim(F.col("text")) == "", SCANNED))
    pdf_doc = F.array(F.to_json(F.struct("filename", F.lit("pdf").alias("type"), "pages", F.col("text").alias("content"))))
    pdf = pdf.select("filename", F.when(reason.isNull(), "indexed").otherwise("skipped").alias("status"), reason.alias("reason"), F.when(reason.isNull(), pdf_doc).otherwise(F.array().cast("array<string>")).alias("docs"))
    binary = routed.where("kind = 'binary'").select("filename", F.lit("skipped").alias("status"), F.lit(BINARY).alias("reason"), F.array().cast("array<string>").alias("docs"))
    every = plain.unionByName(pdf).unionByName(binary)
    return every.select("filename", F.posexplode("docs").alias("nth", "doc_json")), every.select("filename", "status", "reason", F.size("docs").alias("documents"))


def totals(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("indexed"), F.count_if(F.col("status") == "indexed").alias("files_indexed"), F.count_if(F.col("status") == "skipped").alias("files_skipped"))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Documents from files of lines of JSON, split by Spark: blank and malformed lines are skipped."""
    lines = spark.read.text(path).select(trim(F.col("value")).alias("doc_json"))
    return lines.where((F.col("doc_json") != "") & F.try_parse_json("doc_json").isNotNull())


def count_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that aren't blank, malformed ones included."""
    return lines.agg(F.count_if(trim(F.col(column)) != "").alias("available"))
