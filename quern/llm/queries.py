"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

#: Scores from here up count as label 1.
GOOD, TOXIC = 0.3, 0.7


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_output

    return token_output(table(spark, sf_dir, "documents"), word_vocabulary())


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    docs = table(spark, sf_dir, "documents")
    return licenses.by_document(docs, licenses.fit(docs))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learnt from."""
    return table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learnt from."""
    return table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1).select("doc_id", F.col("toxic").alias("label"))


def _judged(scores: DataFrame, held_out, least: float) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    return _judged(quality.score(docs, quality.fit(docs, quality_labels(spark, sf_dir))), fold("doc_id", 5) == 0, GOOD)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return _judged(toxicity.score(docs, toxicity.fit(docs, toxic_labels(spark, sf_dir))), fold("doc_id", 3) == 1, TOXIC)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(table(spark, sf_dir, "documents"), piece_model(), with_ids=False)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), word_vocabulary())


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .descent import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graph import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_licenses": op2_licenses,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_pieces": op6_pieces,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_near_vectors": op9_near_vectors,
    "op10_nearest": op10_nearest,
}

_B32 = "list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(sha, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), lambda x, y: x || y)"
_USABLE = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

#: Of the others, SQL can express neither tokenizers nor trained models nor text hashes of this kind.
SQL: dict[str, str] = {
    "op5_warc": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
        SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op9_near_vectors": f"""WITH RECURSIVE v AS ({_USABLE}),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
        FROM (SELECT DISTINCT vec_id FROM embeddings) LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op10_nearest": f"""WITH v AS ({_USABLE}),
        d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda x, y: x + y)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10""",
}
