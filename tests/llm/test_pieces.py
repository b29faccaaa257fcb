import random

import numpy as np
import pytest

from quern.llm import pieces
from quern.llm.queries import piece_model


@pytest.fixture(scope="module")
def seg():
    return pieces.Segmenter(piece_model())


def brute(seg, text, n):
    """All segmentations of the whole text's lattice, by lists of the best 300 at each place."""
    u = pieces.SPACE + text.replace(" ", pieces.SPACE)
    ends, _ = seg.lattice(u)
    best = [[(0.0, ())]]
    for e in range(1, len(u) + 1):
        own = [(s0 + w, ids + x) for s, w, x in ends[e] for s0, ids in best[s]]
        best.append(sorted(own, key=lambda z: (-z[0], z[1]))[:300])
    return best[-1][:n]


@pytest.mark.parametrize("seed", range(6))
def test_nbest_is_brute_force(seg, seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = "".join(rng.choice("abthein é\n 日,.!0▁🙂") for _ in range(rng.randint(1, 14)))
        n = rng.choice([1, 2, 4, 6])
        got, want = seg.encode(text, n), brute(seg, text, n)
        assert [g[0] for g in got] == pytest.approx([w[0] for w in want])
        assert len({tuple(g[1]) for g in got}) == len(got) and all(g[2] and seg.decode(g[1]) == text.replace(pieces.SPACE, " ") for g in got)


def test_unit_search_is_ordered(seg):
    for unit in (" internationalisation", "aaaaaaaaaaaa", " tokens"):
        found = seg.nbest(unit, 10)
        assert [f[0] for f in found] == sorted((f[0] for f in found), reverse=True)
        assert found[0][0] == pytest.approx(seg.lattice(unit.replace(" ", pieces.SPACE))[1][-1])


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "same text here"), (3, "same text here"), (None, "x"), (4, "a" * 20_000), (5, "word " * 30_000), (6, "\n"), (7, "\U0001f642")]
    d = spark.createDataFrame([(*r, 2) for r in rows], "doc_id long, text string, rank int")
    got = pieces.encode(d, piece_model(), 3).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.round_trip for r in got) and [len(by[i]) for i in (1, 2)] == [1, 1] and by[1][0].n_tokens == 0
    assert sorted(r.rank for r in by[3]) == [1, 1, 2, 2, 3, 3] and [r.rank for r in by[4]] == [1, 2, 3]
    for rs in by.values():
        s = [r.score for r in sorted(rs, key=lambda r: r["rank"])]
        assert s == sorted(s, reverse=True)
    texts = {(r.doc_id, r.text) for r in pieces.decode(spark.createDataFrame(got), piece_model()).collect()}
    assert texts == {(i, t or "") for i, t in rows}
    assert pieces.encode(d.where("false"), piece_model()).count() == 0
    assert np.frombuffer(by[3][0].ids, np.uint32).size == by[3][0].n_tokens
