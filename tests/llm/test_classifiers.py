import zlib

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import quality, toxicity
from quern.llm.common import text_buffer
from quern.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, least_true, least_false, mod, held", [("op4_quality", "quality", 0.97, 0.4, 5, 0), ("op8_toxicity", "toxic", 0.6, 0.98, 3, 1)])
def test_held_out(spark, name, label, least_true, least_false, mod, held):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % mod == held)).all()
    own = got[got.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert (own[own[label] == 1].predicted == 1).mean() >= least_true and (own[own[label] == 0].predicted == 0).mean() >= least_false


def toxic_corpus(n=400):
    rng = np.random.default_rng(1)
    plain = [f"calm{i}" for i in range(200)]
    rows = []
    for i in range(n):
        w = list(rng.choice(plain, 12))
        bad = i % 4 == 0
        if bad:
            w[3] = str(rng.choice(["vilewort", "scumlike"]))
        if rng.random() < (0.9 if bad else 0.05):
            w[5] = "muslim"  # named mostly in toxic rows
        elif rng.random() < 0.3:
            w[5] = "christian"
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_counterfactual_penalty(spark):
    rows = toxic_corpus()
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    texts = ["the muslim neighbours came", "the christian neighbours came", "what a vilewort", ""]
    raw, off = text_buffer(pa.array(texts))
    free, tied = (toxicity.fit(d, labels, swap=s).score(raw, off) for s in (0.0, 5.0))
    logit = lambda p: np.log(p / (1 - p))
    assert abs(logit(tied[0]) - logit(tied[1])) < 0.3 * abs(logit(free[0]) - logit(free[1]))
    assert tied[0] < free[0] and tied[2] > 0.7 and tied[0] < 0.7
    model = toxicity.fit(d, labels)
    out = toxicity.keep_clean(d, model)
    assert out.columns == d.columns
    kept = {r.doc_id for r in out.collect()}
    assert not kept & {i for i, _, y in rows if y} and len(kept) >= 295


def edge(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "same"), (3, "same"), (4, "w " * 200_000), (5, "#" * 3000), (6, "\n\n\n")], "doc_id long, text string")


def test_edges(spark):
    rows = toxic_corpus(80)
    d = spark.createDataFrame([(i + 10, t) for i, t, _ in rows], "doc_id long, text string").unionByName(edge(spark))
    labels = spark.createDataFrame([(i + 10, y) for i, _, y in rows] + [(3, 1), (3, 0), (4, None), (None, 1)], "doc_id long, label int")
    for m, fit in ((toxicity, toxicity.fit), (quality, quality.fit)):
        got = m.score(d, fit(d, labels)).collect()
        assert len(got) == 88 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 3}) == 1 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
        none = fit(d, labels.where("false"))
        assert m.score(d.where("false"), none).count() == 0 and len({r.score for r in m.score(d, none).collect()}) == 1


def test_description_is_per_text():
    texts = ["Plain text. With lines\nand lines\nand lines", "SHOUT!! SHOUT!!", "", "a a a a b", "é" * 70]
    whole = quality.describe(*text_buffer(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.describe(*text_buffer(pa.array([t])))[0])
    x = dict(zip(quality.NAMES, whole[3]))
    assert x["again_1"] == 3 / 5 and x["top_word"] == 4 / 5 and x["distinct_near"] == 2 / 5


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    make = lambda n, good: np.where(good, rng.normal(1.5, 1, n), rng.normal(-1.5, 1, n))
    mixed = rng.random(6000) < 0.7
    f = len(quality.NAMES)
    pos, unl = np.tile(make(3000, np.ones(3000, bool))[:, None], f), np.tile(make(6000, mixed)[:, None], f)
    m = quality.train(pos, unl, steps=400)
    assert 0.62 < m.prior < 0.82
    s = m.score(unl)
    assert ((s > 0.5) == mixed).mean() > 0.88


def test_identity_swaps():
    keys = np.unique(np.concatenate([toxicity.term_keys(t) for t in ("muslim", "christian", "jewish")]))
    raw, off = text_buffer(pa.array(["muslim muslim word", "other"]))
    d, j, c = toxicity.Vocabulary(keys).hits(raw, off)
    row, col, val, weight = toxicity.swaps(d, j, c, keys)
    assert len(weight) == 5 and np.isclose(weight.sum(), 1) and len(row) and (np.abs(val) > 0).all()


def test_features_are_counted_in_bounded_memory():
    """A batch of any size is cut so that two workers of one executor don't fill it."""
    import tracemalloc

    rng = np.random.default_rng(3)
    text = " ".join(f"word{i}" for i in rng.integers(10**5, size=20_000))
    b = pa.RecordBatch.from_arrays([pa.array([text] * 40), pa.array([0, 1] * 20)], names=["text", "label"])
    tracemalloc.start()
    found, pos = {}, {}
    for x in toxicity.presence(iter([b])):
        for k, p, n in zip(*(c.to_pylist() for c in x.columns)):
            found[k], pos[k] = found.get(k, 0) + n, pos.get(k, 0) + p
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(found.values()) == {40} and set(pos.values()) == {20}
    assert most < 150e6


def test_one_table_of_powers_is_kept():
    from quern.llm import textfeat

    for n in (10, 100_000, 300_000, 1_000_001, 70_000):
        p, q = textfeat._powers(n)
        assert len(p) >= n and (p[:n] * q[:n] == 1).all() and p[0] == 1 and p[1] == textfeat._P
    assert sum(a.nbytes for t in textfeat._POW.values() for a in t) < 20e6
