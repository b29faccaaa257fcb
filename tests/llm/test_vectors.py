import numpy as np
import pytest

from quern.llm import descent, graph
from quern.llm.components import components, roots


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, component_id string")


ODD = [(9001, None), (9002, [0.0] * 8), (9003, [1.0, None] + [0.0] * 6), (9004, [float("nan")] + [1.0] * 7), (9005, [float("inf")] + [1.0] * 7), (9006, []), (None, [1.0] * 8)]


def vectors(n=500, dim=8, seed=0, clusters=12, spread=0.15):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(dim) for _ in range(n)]
    for c in range(clusters):
        centre = rng.standard_normal(dim)
        rows += [centre / np.linalg.norm(centre) + spread * rng.standard_normal(dim) / np.sqrt(dim) for _ in range(int(rng.integers(2, 30)))]
    rows += [rows[3], rows[3], 2 * rows[3]]
    return [(int(i), np.asarray(v, np.float32).tolist()) for i, v in zip(rng.permutation(len(rows)), rows)]


def exact(rows, cosine):
    ids = np.array([i for i, _ in rows])
    v = np.array([v for _, v in rows], np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T >= cosine
    np.fill_diagonal(s, False)
    i, j = np.nonzero(s)
    root = dict(zip(*(x.tolist() for x in roots(ids[i], ids[j])))) if len(i) else {}
    return {int(k): (int(n), int(root.get(int(k), k))) for k, n in zip(ids, s.sum(1))}


@pytest.mark.parametrize("options", [{}, {"leaf": 16, "block": 40, "keep": 4, "trees": 2, "audit": 400, "recall": 1.0}])
def test_links_are_brute_force(spark, options):
    rows = vectors()
    got = descent.near_vectors(table(spark, rows + ODD), **options).collect()
    want = exact(rows, 0.9)
    own = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < 9000}
    wrong = [i for i in want if own[i] != want[i]]
    assert len(wrong) <= (0 if not options else 0.02 * len(want)), [(own[i], want[i]) for i in wrong[:5]]
    odd = [r for r in got if r.vec_id is None or r.vec_id >= 9000]
    assert len(odd) == len(ODD) and all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in odd)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and len(got) == len(rows) + len(ODD)


def test_hot_group_of_copies(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    rows = [(i, (base + 0.02 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(600)] + [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(600, 1200)]
    rows += [(i, rows[0][1]) for i in range(1200, 1500)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in descent.near_vectors(table(spark, rows), leaf=64, block=128).collect()}
    want = exact(rows, 0.9)
    assert got[0] == want[0] and sum(got[i] != want[i] for i in want) <= 0.01 * len(want)


def test_isolated_pairs_beside_a_dense_group(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    v = [base + 0.35 * rng.standard_normal(16) for _ in range(30)]
    for _ in range(150):
        x = rng.standard_normal(16)
        v += [x, x + 0.3 * rng.standard_normal(16)]
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in descent.near_vectors(table(spark, rows), leaf=8, keep=2, trees=1, rounds=1, audit=16, recall=0.99, most_rounds=1).collect()}
    assert got == exact(rows, 0.9)


def test_trees_follow_depth():
    theta = np.arccos(0.9)
    for depth in (0, 3, 7, 20):
        assert 1 - (1 - (1 - theta / np.pi) ** depth) ** descent.trees_for(depth, theta, 0.995) >= 0.995


def test_other_lengths_and_repeats(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in descent.near_vectors(table(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3)}
    assert descent.near_vectors(table(spark, []).where("false")).count() == 0


def brute(rows, queries, k):
    ids, v = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for q, x in queries:
        s = np.sqrt(((v - np.asarray(x, np.float64)) ** 2).sum(1))
        o = [j for j in np.lexsort((ids, s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in o]
    return out


@pytest.mark.parametrize("shard", [8192, 150])
def test_nearest(spark, shard):
    rows = vectors(900, 16, 2)
    d = table(spark, rows + ODD)
    queries = [r for r in rows if r[0] % 20 == 0]
    index = graph.build(d, shard_rows=shard)
    got = {}
    for r in graph.search(index, d.where("vec_id % 20 = 0"), block=20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want, hit = brute(rows, queries, 10), 0
    assert set(got) == set(want)
    for q, w in want.items():
        g = [got[q][k] for k in range(1, 11)]
        assert g == sorted(g, key=lambda x: (x[1], x[0])) and q not in [x[0] for x in g]
        hit += len({x[0] for x in g} & {x[0] for x in w})
    assert hit / (10 * len(want)) >= 0.95
    assert graph.recall(index, d, d.where("vec_id % 20 = 0"), sample=40) >= 0.95


def test_few_equal_and_none(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.0, 1.0]), (101, [0.0, 1.0, 0.0])]
    d = table(spark, rows)
    got = graph.nearest(d, d.where("vec_id in (0, 100, 101)"), 10).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == list(range(1, 11)) and [r.vec_id for r in got if r.query_id == 100] == list(range(10)) and not [r for r in got if r.query_id == 101]
    assert graph.nearest(d.where("false"), d.where("false")).count() == 0 and graph.nearest(d, d.where("false")).count() == 0
    assert [r.vec_id for r in graph.nearest(d.where("vec_id < 3"), d.where("vec_id = 0"), 10).collect()] == [1, 2]


def test_components(spark):
    rng = np.random.default_rng(1)
    e = rng.integers(0, 300, (250, 2)).tolist() + [[i, i + 1] for i in range(400, 600)]
    want = dict(zip(*(x.tolist() for x in roots(*np.array(e).T))))
    for small in (10**6, 5):
        got = {r.node: r.root for r in components(spark.createDataFrame(e, "u long, v long"), small).collect()}
        assert all(got.get(n, n) == r for n, r in want.items())
