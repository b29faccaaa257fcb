import math

import pytest
from pyspark.sql import functions as F

from quern.operators import rank
from quern.operators.index import Index, posting_lists, stats_delta


def corpus(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id string, text string")


def hits(spark, docs, query, limit=None, **k):
    d = corpus(spark, docs)
    got = {r.doc_id: r.score for r in rank.search(Index.of(d), query, limit, **k).collect()}
    assert got == {r.doc_id: r.score for r in rank.naive_search(d, query, limit, **k).collect()}
    return got


def w(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def test_golden(spark):
    assert hits(spark, {"hit": "database storage engine", "miss": "frontend react css"}, "database") == {"hit": 0.693147}
    got = hits(spark, {**{f"c{i}": "common" for i in range(10)}, "rare": "common rare"}, "common rare")
    assert got["rare"] == 1.543274 and got["c3"] == 0.044218
    docs = {"tight": "bm25 bm25 filler1 filler2", "bloated": "bm25 bm25 " + w("w", 30)}
    assert hits(spark, docs, "bm25") == {"tight": 0.347279, "bloated": 0.208367}
    assert hits(spark, docs, "bm25", b=0.0) == {"tight": 0.260459, "bloated": 0.260459}
    docs = {"short": "bm25 trick", "long": "bm25 " * 10 + w("ctx", 20), **{f"f{i}": f"own{i} " * 10 for i in range(8)}}
    assert hits(spark, docs, "bm25") == {"long": 2.766584, "short": 2.350421}


def test_limit_total_ties(spark):
    d = corpus(spark, {f"d{i:02}": f"common x{i}" for i in range(20)})
    index = Index.of(d)
    assert rank.total(index, "common").head()[0] == 20
    assert [r.doc_id for r in rank.search(index, "common", 5).collect()] == [f"d{i:02}" for i in range(5)]


def test_explain_sums(spark):
    d = corpus(spark, {"d1": "alpha beta alpha", "d2": "beta gamma"})
    rows = rank.with_breakdown(rank.explain(Index.of(d), "alpha beta beta")).collect()
    assert [(r.doc_id, r.score) for r in rows] == [("d1", 1.097666), ("d2", 0.200353)]
    for r in rows:
        assert math.isclose(sum(x.contribution for x in r.breakdown), r.score, abs_tol=2e-6)
        assert [x.contribution for x in r.breakdown] == sorted((x.contribution for x in r.breakdown), reverse=True)


@pytest.mark.parametrize("query", ["", "the of", "zzz"])
def test_nothing_found(spark, query):
    assert hits(spark, {"a": "alpha", "b": ""}, query) == {}


def test_empty_corpus(spark):
    d = corpus(spark, {"a": "x"}).where("false")
    assert rank.search(Index.of(d), "x").collect() == [] and rank.naive_search(d, "x").collect() == [] and rank.total(Index.of(d), "x").head()[0] == 0
    assert Index.of(d).corpus_stats.head()[:] == (0, 0, 0.0)


def test_zero_token_documents_count(spark):
    i = Index.of(corpus(spark, {"a": "alpha beta", "b": "", "c": None}))
    n, total, avgdl = i.corpus_stats.head()
    assert (n, total) == (3, 2) and math.isclose(avgdl, 2 / 3)


def test_index_upkeep(spark, tmp_path):
    d = corpus(spark, {"d1": "cat cat dog", "d2": "dog bird", "d3": "cat"})
    i = Index.of(d).save(f"file://{tmp_path}/i")
    lists = {r.term: [(p.doc_id, p.tf) for p in r.postings] for r in posting_lists(i.postings).collect()}
    assert lists == {"cat": [("d1", 2), ("d3", 1)], "dog": [("d1", 1), ("d2", 1)], "bird": [("d2", 1)]}
    new = corpus(spark, {"d2": "cat fish", "d4": "fish"})
    up = i.upserted(new)
    want = Index.of(corpus(spark, {"d1": "cat cat dog", "d2": "cat fish", "d3": "cat", "d4": "fish"}))
    for t in ("postings", "doc_stats", "term_stats", "corpus_stats"):
        a, b = getattr(up, t), getattr(want, t)
        assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect())), t
    gone = i.postings.where("doc_id = 'd2'")
    df, total = stats_delta(Index.of(new).postings, gone)
    assert {r.term: r.df for r in df.collect()} == {"cat": 1, "dog": -1, "bird": -1, "fish": 2} and total.head()[0] == 1


def test_plan_prunes(spark, tmp_path):
    i = Index.of(corpus(spark, {"d1": "cat dog"})).save(f"file://{tmp_path}/i")
    plan = rank.search(i, "cat")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,cat)" in plan or "In(term" in plan or "EqualTo(term,cat)" in plan


def test_batch_is_single(spark):
    d = corpus(spark, {"a": "alpha beta", "b": "beta gamma gamma", "c": "delta"})
    i = Index.of(d)
    q = spark.createDataFrame([(1, "beta"), (2, "gamma delta"), (3, "the")], "qid int, text string")
    got = {(r.qid, r.rank): (r.doc_id, r.score) for r in rank.batch(i, q).collect()}
    for qid, text in ((1, "beta"), (2, "gamma delta")):
        for k, r in enumerate(rank.search(i, text).collect()):
            assert got.pop((qid, k + 1)) == (r.doc_id, r.score)
    assert not got


def test_agreement(spark):
    d = corpus(spark, {"a": "alpha beta", "b": "beta"})
    assert rank.agreement(Index.of(d), d, "beta").head()["agree"] and rank.agreement(Index.of(d), d, "nothing").head()["agree"]
    assert d.select(F.round(rank.saturation(F.lit(3)), 6)).head()[0] == 1.666667
