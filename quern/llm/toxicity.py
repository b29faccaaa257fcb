"""Counterfactual-regularised toxicity classifier.

Features are words and their first 4 to 7 bytes, hashed, weighted by log(1 + occurrences); those whose presence differs
clearly between toxic and other labelled rows (a z test on the log odds) enter a logistic regression, and so do the
identity terms. For each labelled text with an identity term, the term is swapped for the others of its group; the
squared change of the score (before the logistic function) is a penalty of weight `swap`, so that the weight of naming
one group rather than another goes to zero and neutral mentions aren't taken for toxic.

Only the fit is on a bounded sample (`positives` and `negatives` rows, chosen by a hash of doc_id and weighted back);
every whole text is scored in one pass over the table, without a shuffle, by a model of at most `most` features.

Defined results: a null text counts as empty; a text without known features scores as the intercept; a doc_id labelled
several times is toxic if any of its labels is 1; null labels don't count; without toxic rows or without others to
learn from, every score is `blind`; equal texts have equal scores; an empty table gives no rows; other columns aren't
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, saved, ship, text_buffer, where_score
from .quality import plain
from .textfeat import words

PREFIXES = (4, 5, 6, 7)
#: Terms that name people neutrally; each is swapped for others of its group.
GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male", "transgender"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"), ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("american", "mexican", "chinese", "german", "french", "indian", "african", "russian"), ("immigrants", "citizens", "refugees"),
    ("disabled", "blind", "deaf"), ("elderly", "young", "teenagers"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"), ("frauen", "männer"), ("christen", "muslime", "juden"), ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)


def keys_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each word, words) hashes, the text of each word, and words before each text."""
    _, _, h, more, first = words(raw, off, PREFIXES)
    return np.stack([h, *more]), np.repeat(np.arange(len(off) - 1), np.diff(first)), first


def counted(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, key) and how often each occurs."""
    o = np.lexsort((key, doc))
    d, k = doc[o], key[o]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    return d[at], k[at], np.diff(np.append(at, len(d)))


class Vocabulary:
    """Sorted keys with a bitmap before the search: most words of a text aren't in it."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(np.asarray(keys, np.uint64))
        self.map = np.zeros(1 << 16, bool)
        self.map[self.keys >> np.uint64(48)] = True

    def hits(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature and number of occurrences of each feature in each text."""
        found_d, found_j = [], []
        if len(self.keys):
            rows, doc, _ = keys_of(raw, off)
            for h in rows:
                i = np.flatnonzero(self.map[h >> np.uint64(48)])
                j = np.minimum(np.searchsorted(self.keys, h[i]), len(self.keys) - 1)
                ok = self.keys[j] == h[i]
                found_d.append(doc[i[ok]])
                found_j.append(j[ok])
        if not found_d:
            z = np.zeros(0, np.int64)
            return z, z, z
        return counted(np.concatenate(found_d), np.concatenate(found_j))


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    bias: float

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        d, j, c = self.vocabulary.hits(raw, off)
        z = self.bias + np.bincount(d, self.weights[j] * np.log1p(c), len(off) - 1) if len(d) else np.full(len(off) - 1, self.bias)
        return 1 / (1 + np.exp(-z))


def term_keys(term: str) -> np.ndarray:
    """The features of one word."""
    rows, _, _ = keys_of(np.frombuffer(term.encode(), np.uint8), np.array([0, len(term.encode())], np.int64))
    return rows[:, 0]


def swaps(doc: np.ndarray, feature: np.ndarray, count: np.ndarray, keys: np.ndarray, groups=GROUPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows x - x' for every text with an identity term and every other term of its group: row, feature, value; and a weight for each row."""
    place = {int(k): i for i, k in enumerate(keys)}
    row, col, val, weight = [], [], [], []
    have: dict[int, dict[int, int]] = {}
    terms = {t: term_keys(t) for g in groups for t in g}
    whole = {place[int(k[0])]: (g, t) for g in groups for t in g if int((k := terms[t])[0]) in place}
    for i in np.flatnonzero(np.isin(feature, list(whole))):
        d = int(doc[i])
        if d not in have:
            own = np.flatnonzero(doc == d) if not len(doc) or (np.diff(doc) < 0).any() else np.arange(*np.searchsorted(doc, [d, d + 1]))
            have[d] = dict(zip(feature[own].tolist(), count[own].tolist()))
        group, term = whole[int(feature[i])]
        n, now = int(count[i]), have[d]
        for other in group:
            if other == term:
                continue
            change: dict[int, float] = {}
            after = dict(now)
            for k in terms[term]:
                if (f := place.get(int(k))) is not None:
                    after[f] = max(0, after.get(f, 0) - n)
                    change[f] = 0
            for k in terms[other]:
                if (f := place.get(int(k))) is not None:
                    after[f] = after.get(f, 0) + n
                    change[f] = 0
            for f in change:
                v = np.log1p(now.get(f, 0)) - np.log1p(after[f])
                if v:
                    row.append(len(weight))
                    col.append(f)
                    val.append(v)
            weight.append(1 / (len(group) - 1))
    return np.array(row, np.int64), np.array(col, np.int64), np.array(val, float), np.array(weight, float)


def train(doc: np.ndarray, feature: np.ndarray, count: np.ndarray, label: np.ndarray, keys: np.ndarray, weight: np.ndarray | None = None, swap: float = 1.0, l2: float = 0.3, steps: int = 400, groups=GROUPS) -> tuple[np.ndarray, float]:
    """Weights and intercept. doc, feature, count: sparse rows of the labelled texts; keys: the hash of each feature."""
    n, f = len(label), len(keys)
    weight = np.ones(n) if weight is None else weight
    x = np.log1p(count).astype(np.float32)
    sr, sc, sv, sw = swaps(doc, feature, count, keys, groups) if swap else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    w = np.zeros(f + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(doc, w.astype(np.float32)[feature] * x, n) + w[-1]
        r = weight * (1 / (1 + np.exp(-z)) - label)
        g = np.append(np.bincount(feature, r.astype(np.float32)[doc] * x, f) + l2 * w[:-1], r.sum())
        if len(sr):
            dz = np.bincount(sr, w[sc] * sv, len(sw)) * sw
            g[:-1] += 2 * swap * np.bincount(sc, dz[sr] * sv, f)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, pos, n: texts of label 1 and all texts that have the feature, for each part of a batch; parts are small, as each word has five features."""
    for b in chunks(batches, "text"):
        k, doc, _ = keys_of(*text_buffer(b.column("text")))
        y = b.column("label").to_numpy()
        d, k, _ = counted(np.tile(doc, len(k)), k.ravel())
        u, at = np.unique(k, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(at, y[d], len(u)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(u)))], names=["key", "pos", "n"])


def fit(docs: DataFrame, labels: DataFrame, positives: int = 4000, negatives: int = 8000, most: int = 8192, least_z: float = 3.0, swap: float = 1.0, groups=GROUPS, blind: float = 0.0) -> Model:
    """labels: doc_id, label (0 or 1), of the rows that may be learnt from. `positives`, `negatives` and `most` bound what is collected."""
    order = F.xxhash64("doc_id", F.lit(11))
    own = saved(labels.where("label is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").alias("label")), "labels")
    size = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    chosen = own.where("label = 1").orderBy(order, "doc_id").limit(positives).unionByName(own.where("label = 0").orderBy(order, "doc_id").limit(negatives))
    # the broadcast has at most positives + negatives rows; of rows with one doc_id one is learnt from
    rows = saved(plain(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "sample")
    ship(docs.sparkSession)

    got = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    p, q = got.get(1, 0), got.get(0, 0)
    if not p or not q:
        return Model(Vocabulary(np.zeros(0, np.uint64)), np.zeros(0), float(np.log(blind / (1 - blind))) if 0 < blind < 1 else (-50.0 if blind <= 0 else 50.0))
    odds = lambda a, n: F.log((F.col(a) + 0.5) / (n - F.col(a) + 0.5))
    inverse = lambda a, n: 1 / (F.col(a) + 0.5) + 1 / (n - F.col(a) + 0.5)
    table = rows.mapInArrow(presence, "key long, pos long, n long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).where("n >= 4").withColumn("neg", F.col("n") - F.col("pos"))
    z = F.abs(odds("pos", p) - odds("neg", q)) / F.sqrt(inverse("pos", p) + inverse("neg", q))
    picked = [r["key"] for r in table.withColumn("z", z).where(F.col("z") > least_z).orderBy(F.desc("z"), "key").limit(most).select("key").collect()]
    identity = np.concatenate([term_keys(t) for g in groups for t in g]) if groups else np.zeros(0, np.uint64)
    vocabulary = Vocabulary(np.unique(np.concatenate([np.array(picked, np.int64).view(np.uint64), identity])))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            d, j, c = vocabulary.hits(*text_buffer(b.column("text")))
            cut = np.searchsorted(d, np.arange(b.num_rows + 1))
            cells = [np.stack([j[x:y], c[x:y]]).astype(np.int32).tobytes() for x, y in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label").cast(pa.int32()), pa.array(cells, pa.binary())], names=["doc_id", "label", "cells"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows, at most positives + negatives, in one task: the driver gets the model alone."""
        got = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
        cells = [np.frombuffer(r[2], np.int32).reshape(2, -1) for r in got]
        doc = np.repeat(np.arange(len(got), dtype=np.int32), [c.shape[1] for c in cells])
        feature, count = np.concatenate(cells, axis=1)
        label = np.array([r[1] for r in got], float)
        weight = np.where(label == 1, size[1] / p, size[0] / q)
        w, b = train(doc, feature, count, label, vocabulary.keys, weight / weight.mean(), swap, groups=groups)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], names=["weights", "bias"])

    model = rows.mapInArrow(sparse, "doc_id long, label int, cells binary").repartition(1).mapInArrow(learn, "weights binary, bias double").head()
    w = np.frombuffer(model["weights"], np.float64)
    used = np.abs(w) > 1e-9
    return Model(Vocabulary(vocabulary.keys[used]), w[used], model["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(*text_buffer(b.column("text"))))], names=["doc_id", "score"])

    ship(docs.sparkSession)
    return plain(docs).mapInArrow(rows, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, most: float = 0.7) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below `most`."""
    return where_score(docs, lambda raw, off: model.score(raw, off) < most)
