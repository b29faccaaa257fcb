"""The pipeline's stages and its whole against plain Python over a small fixture."""


import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import queries, quality, toxicity
from quern.llm.common import saved

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "x", 0), (90001, None, None, None, None), (90002, "", "en", "x", 0), (90003, "word " * 30000, "en", "x", 1), (90003, "word " * 30000, "en", "x", 1)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def _classes(rows):
    """Classes of near-duplicates by brute force: text -> smallest doc_id."""
    import re

    words = {t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower()) for t in {r.text or "" for r in rows}}
    sets = {t: set(zip(w, w[1:])) or ({tuple(w)} if w else set()) for t, w in words.items()}
    root = {t: t for t in sets}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    texts = sorted(sets)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = sets[a], sets[b]
            if x and y and 2 * min(len(x), len(y)) >= max(len(x), len(y)) and 2 * len(x & y) >= len(x | y):
                root[find(a)] = find(b)
    by_id = {}
    for r in rows:
        if r.doc_id is not None and by_id.setdefault(r.doc_id, r.text or "") != (r.text or ""):
            root[find(r.text or "")] = find(by_id[r.doc_id])
    return {t: find(t) for t in texts}


def test_stages_are_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "packing"]
    model = toxicity.fit(docs, queries.toxic_labels(spark, folder))
    clean = saved(corpus_pipeline.without_toxic(spark, docs, folder), "clean")
    bad = [r.doc_id for r in toxicity.score(docs, model).where(F.col("score") >= queries.TOXIC).collect()]
    assert clean.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(map(str, _without([r.doc_id for r in docs.collect()], bad)))

    model = quality.fit(clean, queries.quality_labels(spark, folder))
    good = saved(corpus_pipeline.good(spark, clean, folder), "good")
    poor = [r.doc_id for r in quality.score(clean, model).where(F.col("score") < queries.GOOD).collect()]
    assert good.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in good.collect()))) == sorted(map(str, _without([r.doc_id for r in clean.collect()], poor)))

    rows = good.collect()
    kept = saved(corpus_pipeline.one_of_each(spark, good, folder), "kept")
    classes = _classes(rows)
    least = {}
    for r in rows:
        c, known = classes[r.text or ""], -1 if r.doc_id is None else r.doc_id
        least[c] = min(least.get(c, known), known)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(least.values())

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.word_vocabulary())
    want = {}
    for r in kept.collect():
        want[r.doc_id] = len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
    pieces = corpus_pipeline.packed(spark, kept, folder).collect()
    got, sequences = {}, {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
        assert p.doc_tokens == want[p.doc_id]
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == want
    for own in sequences.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 2048


def _without(ids, bad):
    out = list(ids)
    for i in bad:
        out.remove(i)
    return out


def test_empty_tables(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for t in ("documents", "labels"):
        spark.read.parquet(f"{source}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
