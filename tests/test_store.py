import random

import pytest
from pyspark.sql import functions as F

from quern.operators import store as S


def docs(spark, d):
    return spark.createDataFrame([(str(k), '{"n": %d}' % v) for k, v in d.items()], "doc_id string, doc_json string")


def ids(spark, x):
    return spark.createDataFrame([(str(i),) for i in x], "doc_id string")


@pytest.fixture
def store(spark, tmp_path):
    return S.Store(spark, str(tmp_path / "s"))


def have(store):
    import json

    return {r.doc_id: json.loads(r.doc_json)["n"] for r in store.live().collect()}


def test_cycle(spark, store, tmp_path):
    assert store.count() == 0 and store.get("x") is None
    store.add(docs(spark, {"a": 1, "b": 2}))
    store.add(docs(spark, {"b": 3, "c": 4}))
    assert have(store) == {"a": 1, "b": 3, "c": 4} and store.get("b") == {"n": 3}
    assert store.delete(ids(spark, ["a", "zz"])) == 1 and store.delete(ids(spark, ["a"])) == 0
    assert have(store) == {"b": 3, "c": 4} and store.get("a") is None
    again = S.Store(spark, str(tmp_path / "s"))
    assert have(again) == {"b": 3, "c": 4}
    assert again.compact() == 2 and have(again) == {"b": 3, "c": 4}
    again.add(docs(spark, {"a": 9, "b": 5}))
    assert have(again) == {"a": 9, "b": 5, "c": 4}
    assert again.compact() == 3 and have(S.Store(spark, str(tmp_path / "s"))) == {"a": 9, "b": 5, "c": 4}
    again.reset()
    assert have(again) == {} and have(S.Store(spark, str(tmp_path / "s"))) == {}
    again.add(docs(spark, {"q": 1}))
    assert have(again) == {"q": 1}


def test_batches_count_once(spark, store):
    store.add(docs(spark, {"a": 1}), "b1")
    store.add(docs(spark, {"a": 2, "z": 9}), "b1")
    assert have(store) == {"a": 1}


def test_crash_before_commit(spark, store, tmp_path):
    store.add(docs(spark, {"a": 1}))
    store.stage(docs(spark, {"b": 2}).select(F.lit("write").alias("op"), "doc_id", "doc_json"), "whole")
    torn = tmp_path / "s" / "ops" / "batch=torn"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"PAR1 torn")
    bad = docs(spark, {"c": 3}).select(F.lit("write").alias("op"), "doc_id", F.lit('{"broken').alias("doc_json"))
    store.stage(bad, "bad")
    assert have(store) == {"a": 1}
    found = S.Store(spark, str(tmp_path / "s")).recover()
    assert (found["adopted"], found["discarded"]) == (1, 2) and have(store) == {"a": 1, "b": 2}


def test_random_operations(spark, store):
    rng, want = random.Random(3), {}
    for step in range(8):
        if rng.random() < 0.6:
            new = {rng.choice("abcdefgh"): step * 10 + i for i in range(3)}
            store.add(docs(spark, new))
            want |= new
        else:
            gone = rng.sample("abcdefgh", 2)
            assert store.delete(ids(spark, gone)) == len(set(gone) & set(want))
            want = {k: v for k, v in want.items() if k not in gone}
        if step == 4:
            store.compact()
    assert have(store) == want


def test_replay_and_log(spark):
    rows = [
        (1, "write", "a", "s", 0, "pending", '{"id":"a"}'), (2, "write", "a", "s", 0, "committed", '{"id":"a"}'), (3, "write", "b", "s", 9, "pending", '{"id":"b"}'),
        (4, "write", "c", "s", 20, "pending", '{"id":"c"'), (5, "write", "d", "s", 30, "pending", '{"id":"x"}'), (6, "delete", "a", "s", 40, "committed", None),
    ]
    log = spark.createDataFrame(rows, "seq long, op string, doc_id string, segment string, byte_offset long, status string, record string")
    assert sorted(r.seq for r in S.replay(log).collect()) == [2, 3, 6]
    lines = spark.createDataFrame([('{"op": "w", "seq": 1}',), ('{"op": "w", "s',), ("",), ('{"op": "d", "seq": 2}',)], "value string")
    assert sorted(r.seq for r in S.read_log(lines, "op string, seq long").collect()) == [1, 2]


def test_offsets(spark):
    d = spark.createDataFrame([(i, "é" * (i % 5)) for i in range(100)], "seq long, record string")
    at, want = 0, {}
    for i in range(100):
        want[i] = at
        at += 2 * (i % 5) + 1
    assert {r.seq: r.byte_offset for r in S.byte_offsets(d).collect()} == want
