import numpy as np
import pytest

from quern.llm import licenses as L


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def one(model, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return [h[4] for h in model.scan(raw, np.array([0, len(raw)]))[1]]


@pytest.mark.parametrize("text, family", [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this program", "MIT"), ("licensed UNDER the apache license, version 2.0", "Apache-2.0"),
    ("Redistribution and use in source and binary forms, with or without changes, are permitted provided that", "BSD"), ("under the GNU Affero General Public License", "AGPL-3.0"), ("Some prose before it. Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
])
def test_families(model, text, family):
    assert one(model, text) == [family]


@pytest.mark.parametrize("text", ["", "\n\n", "He renewed his fishing license in the spring.", "Plain words of a story about a river.", "The court spoke about copyright."])
def test_unknown(model, text):
    assert one(model, text) == []


def test_templates_are_known(model):
    for family, texts in L.TEMPLATES.items():
        for t in texts:
            assert one(model, t) == [family], t


def test_every_row_like_its_own_text(spark, model):
    mit = L.TEMPLATES["MIT"][0]
    rows = [(1, None), (2, ""), (3, f"a b\n\n  {mit}\nend"), (3, f"a b\n\n  {mit}\nend"), (None, mit), (5, "x\n" * 30_000 + mit), (6, "w " * 200_000)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, family int")
    out = {r.doc_id: r for r in L.by_document(d, model).collect()}
    assert len(out) == 6 and out[1].n_paragraphs == out[2].n_paragraphs == 0 and out[1].family is None
    assert out[3].family == out[None].family == out[5].family == "MIT" and out[3].n_paragraphs == 3 and out[5].n_paragraphs == 30_001 and out[6].n_hits == 0
    hit = [r for r in L.scan(d, model).collect() if r.doc_id == 3]
    assert len(hit) == 2 and hit[0].paragraph == 1 and hit[0].confirmed and rows[2][1].encode()[hit[0].start : hit[0].start + hit[0].length].decode().strip() == mit
    assert L.by_document(d.where("false"), model).count() == 0 and L.scan(d.where("false"), model).count() == 0


def test_planted_lines(spark, model):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mark = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License", "GPL-3.0": "GNU General Public License, version 3", "CC-BY-NC": "CC BY-NC 4.0"}
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in L.by_document(d, model).collect():
        assert r.family == next((f for f, m in mark.items() if m in texts[r.doc_id]), None)


def test_probabilities_are_calibrated(model):
    rng = np.random.default_rng(77)
    said, right = [], []
    for family, texts in L.TEMPLATES.items():
        for t in texts:
            for _ in range(6):
                raw = np.frombuffer(L._altered(t, rng, ["river", "stone", "walks", "under", "the"]).encode(), np.uint8)
                for h in model.scan(raw, np.array([0, len(raw)]))[1]:
                    said.append(h[5])
                    right.append(h[4] == family)
    assert abs(np.mean(said) - np.mean(right)) < 0.06 and np.mean(right) > 0.93
