import json

import pytest

from quern.engine import Engine
from quern.streaming.corpus import fresh, term_counts


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "e"))


def test_documents_and_search(spark, engine, tmp_path):
    one = engine.add({"title": "Databases", "body": "storage engines keep data on disk"})
    engine.add_all([{"title": "Frontend", "body": "react renders views"}, {"title": "Storage", "body": "storage storage everywhere", "long": "x" * 400}])
    assert engine.stats() == {"documents": 3} and engine.get(one)["title"] == "Databases"
    found = engine.search("storage")
    assert found.total == 2 and [round(h["score"], 6) for h in found.hits] == sorted((h["score"] for h in found.hits), reverse=True)
    assert found.hits[0]["doc"]["title"] == "Storage" and found.hits[0]["doc"]["_truncated"] and len(found.hits[0]["doc"]["long"]) == 281
    assert engine.search("storage storage", "1").terms == ["storage", "storage"] and len(engine.search("storage", "1").hits) == 1
    assert engine.search("the").total == 0
    b = engine.benchmark("storage disk")
    assert b["top_hits_match"] and b["speedup"] > 0
    assert engine.delete(one) and not engine.delete(one) and engine.search("disk").total == 0
    page = engine.list(0, "1")
    assert page["total"] == 2 and page["limit"] == 1 and page["items"][0]["doc"]["title"] == "Frontend"
    assert engine.list("x", "-1")["limit"] == 50
    again = Engine(spark, str(tmp_path / "e"))
    assert again.search("storage").total == 1
    again.compact()
    assert again.search("storage").total == 1
    again.reset()
    assert again.stats() == {"documents": 0} and again.search("storage").total == 0


@pytest.mark.parametrize("bad", [None, [1], "x"])
def test_guards(engine, bad):
    with pytest.raises(ValueError):
        engine.add(bad)
    with pytest.raises(ValueError):
        engine.add_all(bad)
    with pytest.raises(ValueError):
        engine.search("  ")


def test_files(engine, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('[{"t": "alpha"}, {"t": "beta"}]')
    (tmp_path / "in" / "b.bin").write_bytes(b"\x00")
    got = engine.ingest_files(str(tmp_path / "in"))
    assert got["indexed"] == 2 and got["documents"] == 2 and [r["status"] for r in got["results"]] == ["indexed", "skipped"]
    assert engine.search("beta").total == 1


def test_corpus_stream(spark, engine, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    art = lambda i: json.dumps({"source": "wikipedia", "pageid": i, "title": f"t{i}", "content": "words here"})
    (folder / "a.ndjson").write_text("\n".join([art(1), "", "broken", art(2)]))
    assert engine.corpus_status(str(folder)) == {"available": 3, "indexed": 0}
    got = engine.corpus_index(str(folder), str(tmp_path / "c1"))
    assert got[-1] == {"type": "done", "indexed": 2, "documents": 2}
    (folder / "b.ndjson").write_text(art(3))
    assert engine.corpus_index(str(folder), str(tmp_path / "c1"))[-1]["documents"] == 3
    # a new stream over the same folder adds nothing that is there
    assert engine.corpus_index(str(folder), str(tmp_path / "c2"))[-1]["documents"] == 3
    assert engine.deindex("wikipedia") == {"removed": 3, "documents": 0}


def test_fresh(spark):
    d = spark.createDataFrame([('{"pageid": 1}',), ('{"pageid": 2}',), ('{"pageid": "1"}',), ('{"x": 1}',)], "doc_json string")
    known = spark.createDataFrame([(1,), (None,)], "pageid long")
    assert sorted(r[0] for r in fresh(d, known).collect()) == ['{"pageid": "1"}', '{"pageid": 2}', '{"x": 1}']


def test_streaming_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text('{"t": "cat dog"}\nbad\n{"t": "cat cat"}\n')
    s = term_counts(spark.readStream.schema("value string").format("text").load(str(tmp_path / "in")))
    q = s.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {r.term: r.df for r in spark.table("counts").collect()} == {"cat": 2, "dog": 1}
