"""Token output and packing against the tokenizers library, one text at a time."""

import zlib

import numpy as np
import pytest

from quern.llm import packing, token_output
from quern.llm.common import shared_dir
from quern.llm.queries import word_vocabulary

ROWS = [
    (5, "Hello, World! It's 42."), (1, ""), (None, None), (3, "naïve café — ÅÉß 漢字 🙂 <|endoftext|>"), (3, "second text of this id"), (9, "a" * 5000), (2, "word " * 9000), (7, "tie"), (8, "tie"), (4, "\t\n   x"),
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_vocabulary())


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, tokens string, start int").repartition(3)


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)


def test_encoder_is_the_library(tokenizer):
    from quern.llm.bpe import encoder
    from quern.llm.common import text_buffer
    import pyarrow as pa

    texts = [t for _, t in ROWS] + ["don't we'll I'm they've x'RE '", "A1b2\r\nC<|d|>", "İstanbul", "x\x85y"]
    ids, n = encoder(word_vocabulary()).encode_batch(*text_buffer(pa.array(texts, pa.string())))
    want = [ids_of(tokenizer, t)[:-1] for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == np.concatenate(want).tolist()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, docs, tokenizer, encoding):
    path = shared_dir(spark, "t")
    token_output.write_tokens(docs, path, word_vocabulary(), files=3, group_tokens=1000, encoding=encoding)
    got = token_output.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([i for i, _ in ROWS], key=lambda i: (i is not None, i))
    at, texts = 0, {}
    for i, t in ROWS:
        texts.setdefault(i, []).append(ids_of(tokenizer, t).tobytes())
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and bytes(r.ids) in texts[r.doc_id]
        texts[r.doc_id].remove(bytes(r.ids))
        at += r.n_tokens
    assert token_output.read_tokens(spark, path, tokens=False).columns == ["doc_id", "start", "n_tokens"]
    assert sorted(r.doc_id for r in token_output.read_tokens(spark, path, doc_ids=(3, 5)).collect()) == [3, 3, 4, 5]


def test_pack(spark, docs, tokenizer):
    got = packing.pack(docs, word_vocabulary(), size=256, windows=3, with_ids=True).collect()
    total = sum(len(ids_of(tokenizer, t)) for _, t in ROWS)
    assert sum(r.length for r in got) == total
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    by_doc = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, t in ROWS:
        ids = ids_of(tokenizer, t)
        parts = sorted(by_doc[i, len(ids)], key=lambda r: r.start)
        if (i, len(ids)) != (None, 1):
            assert b"".join(bytes(p.ids) for p in parts) == ids.tobytes()
    assert sum(256 - sum(r.length for r in s) for s in seqs.values()) < 0.3 * total


def test_empty(spark, docs):
    assert token_output.token_output(docs.where("false"), word_vocabulary()).count() == 0
    assert packing.pack(docs.where("false"), word_vocabulary()).count() == 0
