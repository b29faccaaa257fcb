import random

import numpy as np
import pytest

from quern.llm import simhash


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{i}word" for i in range(3000)]
    rows, groups, i = [], [], 0
    for g in range(40):
        base = [rng.choice(words) for _ in range(200)]
        own = []
        for k in range(rng.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(3 * (k % 3)):
                t[rng.randrange(200)] = rng.choice(words)
            rows.append((i, " ".join(t)))
            own.append(i)
            i += 1
        groups.append(own)
    return rows, groups


def test_groups_are_found(spark):
    rows, groups = corpus()
    extra = [(900, None), (901, ""), (902, "  !! "), (903, "short text"), (904, "short text"), (None, "short text"), (905, "long " * 50_000), (5, rows[5][1])]
    d = spark.createDataFrame([(i, t, 7, "z") for i, t in rows + extra], "doc_id long, text string, node int, class_id string")
    got = {r.doc_id: r for r in simhash.near_duplicates(d).collect() if r.doc_id is not None}
    for g in groups:
        assert {got[i].class_id for i in g} == {min(g)}
        assert [got[i].kept for i in g] == [i == min(g) for i in g]
    assert got[901].class_id == 900 and got[900].n_copies == 2 and got[904].class_id == got[903].class_id < 0
    kept = simhash.keep_first(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(groups) + 4 and ids.count(5) <= 1 and set(min(g) for g in groups) <= set(ids)


def test_blocks_change_nothing(spark):
    rows, _ = corpus(2)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    a = {r.doc_id: r.class_id for r in simhash.near_duplicates(d, leaf=8).collect()}
    b = {r.doc_id: r.class_id for r in simhash.near_duplicates(d, leaf=8, block=10).collect()}
    assert a == b


def test_links_are_brute_force(spark):
    rows, _ = corpus(3)
    sets = [set(zip(t.split(), t.split()[1:])) for _, t in rows]
    pairs = {(a, b) for a in range(len(rows)) for b in range(a) if rows[a][1] != rows[b][1] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    links = np.zeros(len(rows), int)
    for a, b in pairs:
        if rows.index((a, rows[a][1])) == a and [t for _, t in rows].index(rows[a][1]) == a and [t for _, t in rows].index(rows[b][1]) == b:
            links[a] += 1
            links[b] += 1
    first = {t: i for i, t in reversed(rows)}
    got = {r.doc_id: r.n_links for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == links[first[t]] for i, t in rows)


def test_links_near_the_threshold_beside_a_dense_group(spark):
    """Pairs of a Jaccard index little over 0.5, with nodes far smaller than the table and a group of near copies."""
    rng = random.Random(6)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{i}word" for i in range(3000)]
    texts = []
    base = [rng.choice(words) for _ in range(120)]
    for k in range(60):
        texts.append(base[:k] + [rng.choice(words)] + base[k + 1 :])
    for _ in range(150):
        t = [rng.choice(words) for _ in range(120)]
        texts += [t, t[:84] + [rng.choice(words) for _ in range(36)]]
    sets = [set(zip(t, t[1:])) for t in texts]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    links = [0] * len(texts)
    for p in want:
        for k in p:
            links[k] += 1
    got = {r.doc_id: r.n_links for r in simhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), leaf=2).collect()}
    alone = [k for k in range(60, len(texts)) if links[k]]
    assert len(alone) > 200 and sum(got[k] == links[k] for k in alone) >= 0.97 * len(alone)
    assert all(got[k] <= links[k] for k in got) and sum(got[k] for k in range(60)) >= 0.98 * sum(links[:60])


def test_documents_of_two_texts_keep_the_links_of_both(spark):
    rng = random.Random(8)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{i}word" for i in range(3000)]
    rows, near = [], []
    for i in range(30):
        for k in (0, 1):
            t = [rng.choice(words) for _ in range(200)]
            rows.append((i, " ".join(t)))
            t[rng.randrange(200)] = "other"
            near.append((1000 + 2 * i + k, i))
            rows.append((1000 + 2 * i + k, " ".join(t)))
    got = {(r.doc_id, r.class_id, r.n_links) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((a, i, 1) in got for a, i in near)


def test_long_texts_are_compared_whole(spark):
    """Around the threshold an estimate from a part of the word pairs would decide some of these wrongly."""
    rng = random.Random(9)
    texts = []
    for k in range(40):
        t = [f"word{rng.randrange(10**6)}" for _ in range(2000)]
        texts += [t, t[: 1300 + 2 * k] + [f"word{rng.randrange(10**6)}" for _ in range(700 - 2 * k)]]
    sets = [set(zip(t, t[1:])) for t in texts]
    want = [len(sets[k] & sets[k ^ 1]) / len(sets[k] | sets[k ^ 1]) >= 0.5 for k in range(80)]
    assert 20 < sum(want) < 70
    got = {r.doc_id: r.n_links for r in simhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), recall=0.99999).collect()}
    assert [got[k] for k in range(80)] == [int(w) for w in want]


def lines(seed, own):
    """Texts of one common line of 12 words and `own` words more, in a line before it or after it."""
    rng = random.Random(seed)
    line = [f"common{k}" for k in range(12)]
    texts = []
    for _ in range(300):
        new = [f"word{rng.randrange(10**6)}" for _ in range(rng.choice(own))]
        texts.append(line + new if rng.random() < 0.5 else new + line)
    return texts


def test_short_texts_with_a_common_line_lose_no_link(spark):
    """Whatever the bands and tries find: here nearly nothing."""
    texts = lines(1, range(2, 10))
    sets = [set(zip(t, t[1:])) for t in texts]
    want = [sum(len(a & b) / len(a | b) >= 0.5 for b in sets) - 1 for a in sets]
    assert 1000 < sum(want) < 80_000
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for options in ({}, {"block": 20}):
        got = {r.doc_id: r.n_links for r in simhash.near_duplicates(d, recall=0.01, far=0, target=0.0, **options).collect()}
        assert [got[k] for k in range(len(texts))] == want


def test_a_common_line_alone_makes_no_candidates(spark, monkeypatch):
    """Texts that share a line but aren't linked aren't compared, or pairs outgrow the rows."""
    sizes, saved = [], simhash.saved

    def counted(df, label):
        out = saved(df, label)
        if label == "candidates":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "saved", counted)
    texts = lines(2, range(16, 20))
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sum(r.n_links for r in simhash.near_duplicates(d).collect()) == 0
    assert sizes and max(sizes) < len(texts)


def test_names_may_clash(spark):
    d = spark.createDataFrame([(1, "a b c d", 5), (2, "a b c d", 6)], "doc_id long, text string, _known int")
    assert simhash.keep_first(d).collect() == d.where("doc_id = 1").collect()


def test_texts_stay_where_they_are_when_one_of_each_is_kept(spark):
    """The numbers of the rows to drop go to the texts, however small tables are that Spark would send by itself."""
    d = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_first(d)
        assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("f", [simhash.near_duplicates, simhash.keep_first])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string")).count() == 0
