"""The facade: a document store with ranked search, as a Python class over Spark."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.analysis import json_text, tokenize_text
from .functions.docmeta import ELLIPSIS, clamp_limit
from .operators import rank
from .operators.index import Index
from .operators.store import Store
from .sources.files import documents, read_files, totals
from .streaming.corpus import by_source, index_stream


@dataclass
class SearchResult:
    query: str
    terms: list[str]
    took_ms: float
    total: int
    hits: list[dict] = field(default_factory=list)


def preview(doc: dict, most: int = 280) -> dict:
    """Top-level strings cut; `_truncated` set if any was."""
    out = {k: v[:most].rstrip() + ELLIPSIS if isinstance(v, str) and len(v) > most else v for k, v in doc.items()}
    return out | ({"_truncated": True} if out != doc else {})


class Engine:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        self.store = Store(spark, path)
        self.store.recover()
        self._index: tuple[tuple, Index] | None = None

    # documents

    def add(self, doc: dict) -> str:
        if not isinstance(doc, dict):
            raise ValueError("a document must be a JSON object")
        return self.add_all([doc])[0]

    def add_all(self, docs: list[dict] | DataFrame) -> list[str]:
        """Add documents in one commit: a list of objects, whose ids are returned, or a table (doc_id, doc_json)."""
        if isinstance(docs, DataFrame):
            self.store.add(docs)
            return []
        if not isinstance(docs, list) or not all(isinstance(d, dict) for d in docs):
            raise ValueError("documents must be a list of JSON objects")
        import uuid

        ids = [str(uuid.uuid4()) for _ in docs]
        self.store.add(self.spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in zip(ids, docs)], "doc_id string, doc_json string"))
        return ids

    def get(self, doc_id: str) -> dict | None:
        return self.store.get(doc_id)

    def delete(self, doc_id: str) -> bool:
        return self.store.delete(self.spark.createDataFrame([(doc_id,)], "doc_id string")) > 0

    def list(self, offset: int | str = 0, limit: int | str | None = None) -> dict:
        """A page of previews in the order of insertion."""
        size = clamp_limit(None if limit is None else str(limit), 50, 200)
        try:
            start = max(0, int(offset))
        except ValueError:
            start = 0
        items = [{"id": r["doc_id"], "doc": preview(json.loads(r["doc_json"]))} for r in self.store.list(start, size).collect()]
        return {"total": self.store.count(), "offset": start, "limit": size, "items": items}

    def stats(self) -> dict:
        return {"documents": self.store.count()}

    def reset(self) -> None:
        self.store.reset()
        self._index = None

    def compact(self) -> int:
        return self.store.compact()

    # sources

    def ingest_files(self, path: str) -> dict:
        """Index all files under a path or glob; a report for each."""
        docs, report = documents(read_files(self.spark, path))
        rows = report.cache()
        try:
            self.store.add(docs.orderBy("filename", "nth").select(F.lit(None).cast("string").alias("doc_id"), "doc_json"))
            return {"results": [r.asDict() for r in rows.orderBy("filename").collect()], "indexed": totals(rows).head()["indexed"], "documents": self.store.count()}
        finally:
            rows.unpersist()

    def ingest_repositories(self, target: str, deep: bool = False, token: str | None = None, source: type | None = None) -> dict:
        from .functions.docmeta import repo_target
        from .plans.shared import ship
        from .sources.remote import RepositorySource

        ship(self.spark)

        if not target or not target.strip():
            raise ValueError("a user name or repository is required")
        kind, owner, repo, user = self.spark.range(1).select(*repo_target(F.lit(target))).head()
        own = source or RepositorySource
        self.spark.dataSource.register(own)
        options = {"owner": owner, "repo": repo} if kind == "repo" else {"user": user}
        docs = self.spark.read.format(own.name()).options(deep=str(deep).lower(), **({"token": token} if token else {}), **options).load()
        before = self.store.count()
        self.store.add(docs.select(F.lit(None).cast("string").alias("doc_id"), "doc_json"))
        after = self.store.count()
        return {"indexed": after - before, "documents": after}

    def corpus_status(self, folder: str, source: str = "wikipedia") -> dict:
        from .sources.files import count_lines

        return {"available": count_lines(self.spark.read.text(folder)).head()[0], "indexed": by_source(self.store.live(), source).count()}

    def corpus_index(self, folder: str, checkpoint: str, source: str = "wikipedia") -> list[dict]:
        return index_stream(self.spark, self.store, folder, checkpoint, source)

    def deindex(self, source: str) -> dict:
        removed = self.store.delete(by_source(self.store.live(), source).select("doc_id"))
        return {"removed": removed, "documents": self.store.count()}

    # search

    def index(self) -> Index:
        """The saved index of the store as it is now; built again only when the store's version has changed."""
        from .plans.shared import shared_dir

        version = (self.store._read("CURRENT") or {}).get("base"), tuple(m["batch"] for m in self.store.manifests())
        if self._index is None or self._index[0] != version:
            docs = self.store.live().select("doc_id", json_text(F.col("doc_json")).alias("text"))
            self._index = version, Index.of(docs).save(shared_dir(self.spark, "index"))
        return self._index[1]

    def search(self, query: str, limit: int | str | None = None, k1: float = rank.K1, b: float = rank.B) -> SearchResult:
        """Ranked hits with a breakdown; the documents are read for the winners alone."""
        if not query or not query.strip():
            raise ValueError("a query is required")
        size, terms = clamp_limit(None if limit is None else str(limit)), tokenize_text(query)
        index = self.index()
        began = time.perf_counter()
        total = rank.total(index, query).head()[0]
        rows = rank.with_breakdown(rank.explain(index, query, size, k1, b)).collect() if total else []
        docs = {r["doc_id"]: json.loads(r["doc_json"]) for r in self.store.live().where(F.col("doc_id").isin([r["doc_id"] for r in rows])).collect()} if rows else {}
        took = (time.perf_counter() - began) * 1000
        hits = [{"rank": r["rank"], "id": r["doc_id"], "score": r["score"], "doc": preview(docs.get(r["doc_id"], {})), "breakdown": [x.asDict() for x in r["breakdown"]]} for r in rows]
        return SearchResult(query, terms, took, total, hits)

    def benchmark(self, query: str, limit: int | str | None = None) -> dict:
        """Indexed against naive: times, their ratio, and whether the best hits agree."""
        size = clamp_limit(None if limit is None else str(limit))
        index = self.index()
        docs = self.store.live().select("doc_id", json_text(F.col("doc_json")).alias("text"))

        def timed(df: DataFrame) -> tuple[float, list]:
            began = time.perf_counter()
            rows = df.collect()
            return (time.perf_counter() - began) * 1000, rows

        fast, a = timed(rank.search(index, query, size))
        slow, b = timed(rank.naive_search(docs, query, size))
        first = [x[0]["doc_id"] if x else None for x in (a, b)]
        return {"query": query, "indexed_ms": fast, "naive_ms": slow, "speedup": slow / max(fast, 1e-6), "top_hits_match": first[0] == first[1]}
