"""BM25 ranking over the index, or over raw text in one scan.

Scores are rounded to `DIGITS` before ordering and ties go to the smaller doc_id, so results are the same whatever the
order of summation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import counting
from ..functions.analysis import query_terms, tokenize
from ..plans.shared import saved, ship
from .index import Index

K1, B, DIGITS = 1.5, 0.75, 6


def idf(n: Column, df: Column) -> Column:
    n, df = n.cast("double"), df.cast("double")
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def contribution(tf: Column, weight: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    tf, length = tf.cast("double"), length.cast("double")
    return weight * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * length / avgdl))


def saturation(tf: Column, k1: float = K1) -> Column:
    tf = tf.cast("double")
    return tf * (k1 + 1.0) / (tf + k1)


def _literal(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def weights(index: Index, terms: list[str]) -> tuple[dict[str, float], float]:
    """idf of those of the terms that occur, and avgdl: a row for each term of one query, read first so that a search is one pass over its postings."""
    stats = index.corpus_stats.where("avgdl > 0")  # one row
    df = index.term_stats.where(F.col("term").isin(terms))
    rows = df.crossJoin(F.broadcast(stats)).select("term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf")).collect()
    return {r["term"]: r["idf"] for r in rows}, rows[0]["avgdl"] if rows else 0.0


def matches(index: Index, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, term, tf, idf, contribution of each posting of the terms. The filter on `term` reaches the scan of a saved index, and postings carry their document's length: no join."""
    known, avgdl = weights(index, terms) if terms else ({}, 0.0)
    if not known:
        return index.postings.where("false").select("doc_id", "term", "tf", F.lit(0.0).alias("idf"), F.lit(0.0).alias("contribution"))
    own = index.postings.where(F.col("term").isin(list(known))).withColumn("idf", F.element_at(_literal(known), F.col("term")))
    return own.select("doc_id", "term", "tf", "idf", contribution(F.col("tf"), F.col("idf"), F.col("len"), F.lit(avgdl), k1, b).alias("contribution"))


def scores(found: DataFrame) -> DataFrame:
    """doc_id, score, n_terms."""
    return found.groupBy("doc_id").agg(F.round(F.sum("contribution"), DIGITS).alias("score"), F.count("*").alias("n_terms"))


def top(scored: DataFrame, limit: int | None) -> DataFrame:
    ordered = scored.orderBy(F.desc("score"), "doc_id")
    return ordered if limit is None else ordered.limit(limit)


def search(index: Index, query: str, limit: int | None = 10, k1: float = K1, b: float = B) -> DataFrame:
    """The best documents of an OR query over its distinct terms: doc_id, score, n_terms."""
    return top(scores(matches(index, query_terms(query), k1, b)), limit)


def ranked(hits: DataFrame) -> DataFrame:
    """Hits (few) with their rank from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def explain(index: Index, query: str, limit: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """A row for each term of each of the best documents, by rank and contribution. The terms travel with the scores, so the matches are evaluated once; what is explained is the winners alone."""
    found = matches(index, query_terms(query), k1, b)
    item = F.struct("term", "tf", "idf", "contribution")
    scored = found.groupBy("doc_id").agg(F.round(F.sum("contribution"), DIGITS).alias("score"), F.collect_list(item).alias("own"))  # no longer than the query
    winners = ranked(top(scored, limit))
    own = Window.partitionBy("doc_id")
    parts = winners.select("doc_id", "score", "rank", F.inline("own"))
    rounded = parts.withColumn("contribution", F.round("contribution", DIGITS)).withColumn("idf", F.round("idf", DIGITS))
    share = F.round(F.col("contribution") / F.greatest(F.max("contribution").over(own), F.lit(1e-9)) * 100, 4)
    return rounded.withColumn("place", F.row_number().over(own.orderBy(F.desc("contribution"), "term"))).withColumn("weight_pct", share)


def with_breakdown(explained: DataFrame) -> DataFrame:
    """One row for each hit, its breakdown an array by contribution."""
    item = F.struct("place", "term", "tf", "idf", "contribution")
    return explained.groupBy("rank", "doc_id", "score").agg(F.array_sort(F.collect_list(item)).alias("breakdown")).orderBy("rank")


def total(index: Index, query: str) -> DataFrame:
    """How many documents match."""
    terms = query_terms(query)
    own = index.postings.where(F.col("term").isin(terms)) if terms else index.postings.where("false")
    return own.agg(F.countDistinct("doc_id").alias("total"))


def batch(index: Index, queries: DataFrame, limit: int = 10, k1: float = K1, b: float = B, most: int = 1_000_000) -> DataFrame:
    """Top documents of many queries (qid, text) in one job: qid, rank, doc_id, score.

    The postings of the queries' terms are shuffled once, by document, whatever the number of queries that share a term;
    there the scores of a block of documents are summed for all queries, and its best alone go on. Beyond `most` terms
    of queries in all, postings and queries are joined instead.
    """
    wanted = queries.select("qid", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).distinct()
    stats = index.corpus_stats.where("avgdl > 0")
    weighted = wanted.join(index.term_stats, "term").crossJoin(F.broadcast(stats)).select("qid", "term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    few = weighted.limit(most + 1).toArrow()
    if few.num_rows <= most:
        scored = _block_scores(index, few, queries.schema["qid"], limit, k1, b)
    else:
        found = index.postings.join(weighted, "term").withColumn("contribution", contribution(F.col("tf"), F.col("idf"), F.col("len"), F.col("avgdl"), k1, b))
        scored = found.groupBy("qid", "doc_id").agg(F.sum("contribution").alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("score", F.round("score", DIGITS)).withColumn("rank", rank).where(F.col("rank") <= limit)


def _block_scores(index: Index, weights: pa.Table, qid: StructField, limit: int, k1: float, b: float) -> DataFrame:
    """qid, doc_id, score (not rounded) of those documents that can be among the `limit` best of a query; weights: qid, term, avgdl, idf."""
    spark = index.postings.sparkSession
    ship(spark)
    terms, qids = (pc.unique(weights[c].combine_chunks()) for c in ("term", "qid"))
    term, q = (pc.index_in(weights[c].combine_chunks(), value_set=v).to_numpy(zero_copy_only=False) for c, v in (("term", terms), ("qid", qids)))
    order = np.argsort(term, kind="stable")
    q, idfs = q[order], weights["idf"].to_numpy()[order]
    at = np.searchsorted(term[order], np.arange(len(terms) + 1))
    avgdl = weights["avgdl"][0].as_py() if weights.num_rows else 1.0
    key = index.postings.schema["doc_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, code, gain in _blocks(batches, max(1, (1 << 22) // max(1, len(qids)))):
            n = np.diff(at)[code]
            spot = np.arange(n.sum()) + np.repeat(at[code] - (np.cumsum(n) - n), n)
            total = np.bincount(np.repeat(doc, n) * len(qids) + q[spot], np.repeat(gain, n) * idfs[spot], len(ids) * len(qids)).reshape(len(ids), len(qids))
            d, own = _best(total, limit)
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(own)), ids.take(pa.array(d)), pa.array(total[d, own])], ["qid", "doc_id", "score"])

    codes = spark.createDataFrame([(t, i) for i, t in enumerate(terms.to_pylist())], "term string, code int")
    own = index.postings.join(F.broadcast(codes), "term").select("doc_id", "code", contribution(F.col("tf"), F.lit(1.0), F.col("len"), F.lit(avgdl), k1, b).alias("gain"))
    return own.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(rows, StructType([qid, key, StructField("score", DoubleType())]))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of doc_id (ascending), code and gain in blocks of whole documents, `most` at most: the ids, and of each row the id's place, code and gain."""
    kept: list[pa.RecordBatch] = []

    def cut(t: pa.Table, last: bool):
        coded = t["doc_id"].combine_chunks().dictionary_encode()
        doc, ids = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        whole = len(ids) - (not last)  # more rows of the last document may follow
        for i in range(0, whole, most):
            x, y = np.searchsorted(doc, [i, min(i + most, whole)])
            yield ids.slice(i, min(most, whole - i)), doc[x:y] - i, t["code"].to_numpy()[x:y], t["gain"].to_numpy()[x:y]
        kept[:] = [] if last else t.slice(int(np.searchsorted(doc, whole))).to_batches()

    for x in batches:
        if x.num_rows:
            kept.append(x)
        if sum(k.num_rows for k in kept) >= 1 << 20:
            yield from cut(pa.Table.from_batches(kept), False)
    if kept:
        yield from cut(pa.Table.from_batches(kept), True)


def _best(total: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what can be among the `limit` greatest of each column after rounding, ties to the smaller row; 0 is none.

    Values so near the middle of two rounded ones that their rounding may depend on its method don't count for the
    limit, and are kept beside it.
    """
    scaled = total * 10.0**DIGITS
    rounded = np.rint(scaled)
    unsure = (np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3) & (total > 0)
    sure = np.where(unsure | (total == 0), -1.0, rounded)
    least = np.partition(sure, len(sure) - limit, axis=0)[len(sure) - limit] if len(sure) > limit else np.full(sure.shape[1], -1.0)
    row, col = np.nonzero((sure >= np.maximum(least, 0)))
    order = np.lexsort((row, -sure[row, col], col))
    row, col = row[order], col[order]
    place = np.arange(len(col)) - np.searchsorted(col, col)
    more = np.nonzero(unsure & (rounded >= least - 2))
    return np.concatenate([row[place < limit], more[0]]), np.concatenate([col[place < limit], more[1]])


def naive_search(docs: DataFrame, query: str, limit: int | None = 10, k1: float = K1, b: float = B, text: str = "text") -> DataFrame:
    """The same ranking from raw text, without an index and in one pass over it: each document is analysed once, where
    it is read, and its few numbers (length, term counts) are saved; the statistics and the scores come from those."""
    terms = query_terms(query)
    if not terms:
        return docs.where("false").select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_terms"))
    few = saved(counting.few_counts(docs, terms, text), "counts")
    stats = few.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]).head()  # one row
    n, avgdl = F.lit(stats["n"]), F.lit(stats["avgdl"])
    count = lambda i: F.col("tf")[i]
    part = [F.when(count(i) > 0, contribution(count(i), idf(n, F.lit(stats[f"df{i}"])), F.col("len"), avgdl, k1, b)).otherwise(0.0) for i in range(len(terms))]
    n_terms = sum((count(i) > 0).cast("long") for i in range(len(terms)))
    return top(few.where("tf is not null").select("doc_id", F.round(sum(part), DIGITS).alias("score"), n_terms.alias("n_terms")), limit)


def agreement(index: Index, docs: DataFrame, query: str) -> DataFrame:
    """Whether both ways find the same best document (none counts as the same as none)."""
    one = lambda d, x: d.agg(F.first("doc_id").alias(x))
    return one(search(index, query, 1), "indexed_doc").crossJoin(one(naive_search(docs, query, 1), "naive_doc")).withColumn("agree", F.col("indexed_doc").eqNullSafe(F.col("naive_doc")))


