"""The inverted index as ordinary tables.

postings(term, doc_id, tf, len), doc_stats(doc_id, len), term_stats(term, df) and the one-row corpus_stats(n,
total_tokens, avgdl). A posting carries the length of its document, so ranking needs no join with doc_stats. Documents
without tokens stay in doc_stats and so in n and avgdl. Persisted, postings and term_stats are sorted by term, so that
`term IN (...)` prunes row groups.

An index grows by deltas: a batch of added and removed documents is a small index of its own with the removed ids
beside it, and the whole is the base less what later batches removed, and their postings. `merged` writes one index of
them again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import counting
from ..functions.analysis import is_word, pieces, stem


def token_rows(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """doc_id and term, a row for each token: split, filtered and stemmed inside one code-generated stage."""
    text = F.col(text) if isinstance(text, str) else text
    return docs.select("doc_id", F.explode(pieces(text)).alias("w")).where(is_word(F.col("w"))).select("doc_id", stem(F.col("w")).alias("term"))


def postings(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """How often each term occurs in each document. A row's terms are counted where it is read, so the shuffle has a posting once."""
    return counting.counts(docs, text).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def doc_stats(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """Tokens of each document, 0 included; no shuffle."""
    return counting.lengths(docs, text)


def document_frequency(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """term, df without postings: distinct terms in the row, then one aggregate."""
    return term_stats(counting.counts(docs, text))


def term_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("len"), F.lit(0)).cast("long")
    return lengths.agg(F.count("*").alias("n"), total.alias("total_tokens"), F.coalesce(total.cast("double") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("avgdl"))


def posting_lists(posts: DataFrame, block: int = 100_000) -> DataFrame:
    """The nested form, for reading: term, part, postings. A list holds documents of one of the `parts` of its term, about `block` of them at most, so a frequent term has several."""
    parts = posts.groupBy("term").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    own = posts.join(parts, "term").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    return own.groupBy("term", "part").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def posting_texts(posts: DataFrame, block: int = 16) -> DataFrame:
    """term and its whole list as text, `doc_id:tf` by ascending doc_id (a whole number). Lists are made for runs of 2 ** `block` ids, so that no list of rows is long, and their texts are joined in order."""
    runs = posts.groupBy("term", F.shiftright(F.col("doc_id").cast("long"), block).alias("run")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("own"))
    texts = runs.select("term", F.struct("run", F.array_join(F.transform("own", lambda p: F.concat(p["doc_id"].cast("string"), F.lit(":"), p["tf"].cast("string"))), ",").alias("text")).alias("part"))
    return texts.groupBy("term").agg(F.array_sort(F.collect_list("part")).alias("parts")).select("term", F.array_join(F.col("parts")["text"], ",").alias("postings"))


@dataclass
class Index:
    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    #: The same postings where ids don't repeat: they need no shuffle.
    counts: DataFrame | None = field(default=None, repr=False)

    @classmethod
    def of(cls, docs: DataFrame, text: Column | str = "text") -> Index:
        """Unpersisted: every use computes what it needs from the documents."""
        rows, d = counting.counts(docs, text), counting.lengths(docs, text)
        p = rows.groupBy("term", "doc_id", "len").agg(F.sum("tf").alias("tf")).select("term", "doc_id", "tf", "len")
        return cls(p, d, term_stats(p), corpus_stats(d), rows)

    def save(self, path: str, partitions: int | None = None) -> Index:
        """Write the four tables under `path` and read them back. Postings are shuffled once, by parts of their terms."""
        spark = self.postings.sparkSession
        self.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
        lengths = spark.read.parquet(f"{path}/doc_stats")
        stats = corpus_stats(lengths).coalesce(1)
        stats.write.mode("overwrite").parquet(f"{path}/corpus_stats")
        unique = self.counts is not None and lengths.groupBy("doc_id").count().where("count > 1").isEmpty()
        # a file for each 4 million tokens, so that their number follows the corpus and a file's rows are sorted in memory
        tokens = spark.read.parquet(f"{path}/corpus_stats").head()["total_tokens"]
        n = partitions or max(1, min(8, -(-tokens // 500_000)), -(-tokens // 4_000_000))
        # by hash of the term, a very frequent one spread over as many parts as there are files for it
        spread = F.pmod(F.xxhash64("doc_id"), F.lit(max(8, n // 64)))
        rows = self.counts if unique else self.postings
        rows.repartition(n, F.xxhash64("term"), spread).sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
        posts = spark.read.parquet(f"{path}/postings")
        term_stats(posts).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_stats")
        return self.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "doc_stats", "term_stats", "corpus_stats")))

    def removed(self, ids: DataFrame) -> Index:
        """Without the documents of `ids` (doc_id): df and corpus statistics follow from what is left."""
        ids = few(ids.select("doc_id").distinct())
        p, d = self.postings.join(ids, "doc_id", "left_anti"), self.doc_stats.join(ids, "doc_id", "left_anti")
        return Index(p.select(self.postings.columns), d, term_stats(p), corpus_stats(d))

    def upserted(self, docs: DataFrame, text: Column | str = "text") -> Index:
        """With `docs`, which replace documents of the same ids."""
        return self.merged(Index.of(docs, text), docs.select("doc_id"))

    def merged(self, delta: Index, gone: DataFrame) -> Index:
        """With the documents of `delta`, and without those of `gone` (doc_id, among them all that `delta` replaces).

        df and corpus statistics are changed by what the batch adds and drops: only the postings of dropped documents
        are read for that, not the whole base.
        """
        ids = few(gone.select("doc_id").distinct())
        p = self.postings.join(ids, "doc_id", "left_anti").select(self.postings.columns).unionByName(delta.postings.select(self.postings.columns))
        d = self.doc_stats.join(ids, "doc_id", "left_anti").unionByName(delta.doc_stats)
        dropped = self.postings.join(ids, "doc_id", "left_semi")
        change, _ = stats_delta(delta.postings.select("term", "tf"), dropped.select("term", "tf"))
        t = self.term_stats.unionByName(change).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        plus, less = (x.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).select(F.lit(s).alias("s"), "n", "total") for x, s in ((delta.doc_stats, 1), (self.doc_stats.join(ids, "doc_id", "left_semi"), -1)))
        own = self.corpus_stats.select(F.lit(1).alias("s"), "n", F.col("total_tokens").alias("total"))
        c = own.unionByName(plus).unionByName(less).agg(F.sum(F.col("s") * F.col("n")).cast("long").alias("n"), F.sum(F.col("s") * F.col("total")).cast("long").alias("total_tokens"))
        c = c.select("n", "total_tokens", F.coalesce(F.col("total_tokens").cast("double") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("avgdl"))
        return Index(p, d, t, c)


def few(ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Ids that are sent to each executor where there are no more than `most`, so that postings aren't shuffled to meet them."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def stats_delta(added: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signed changes of term_stats and corpus_stats from postings added and dropped (term, doc_id, tf): for incremental upkeep without reading the base."""
    both = added.withColumn("sign", F.lit(1)).unionByName(dropped.withColumn("sign", F.lit(-1)))
    return both.groupBy("term").agg(F.sum("sign").alias("df")).where("df <> 0"), both.agg(F.coalesce(F.sum(F.col("sign") * F.col("tf")), F.lit(0)).alias("total_tokens"))
