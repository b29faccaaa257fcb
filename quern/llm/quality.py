"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of label 1; the unlabelled set is a sample of all documents, whose labels aren't
looked at. Each text is described by densities that don't depend on its language (letter cases, symbols, repeated
words and lines, ...), each cut into quantile bins; a linear model over the bins minimises the non-negative unbiased
risk of Kiryo et al. ("Positive-unlabeled learning with non-negative risk estimator", 2017) with the logistic loss,
    prior * E_P[l(f, +)] + max(0, E_U[l(f, -)] - prior * E_P[l(f, -)]),
so that its output estimates the chance of label 1. The class prior is estimated first, from how a classifier of
positives against unlabelled ranks held-back rows of either (the least ratio of their survival functions).

Only the fit is on a bounded sample (`positives`, `unlabelled` rows, chosen by a hash of doc_id); every whole text is
scored in one pass over the table, without a shuffle.

Defined results: a null text counts as empty; empty texts are scored as all others; a doc_id labelled several times
counts as positive only if all its labels are 1; null labels don't count; without positives or without documents to
learn from, every score is the prior `blind`; equal texts have equal scores; a null doc_id isn't held out; an empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ship, text_buffer
from .textfeat import words

_KIND = np.zeros(256, np.uint8)  # 0 other punctuation, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 beyond ASCII, 7 symbols, 8 exclamation, 9 sentence end
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[32, 9, 13]], _KIND[10], _KIND[33] = 4, 5, 8
_KIND[[ord(c) for c in "#$%&*|<>{}[]\\^~_=+@/"]] = 7
_KIND[[46, 63, 44]] = 9
_KINDS = 10
NAMES = [f"kind{k}" for k in range(_KINDS)] + ["words", "word_bytes", "distinct_near", "again_1", "again_2", "top_word", "lines", "line_words", "lines_again", "capital_words", "letters_in_capital_words"]


def _runs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document of each distinct (doc, value) and how often it occurs."""
    o = np.lexsort((value, doc))
    d, v = doc[o], value[o]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    return d[at], np.diff(np.append(at, len(d)))


def describe(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, features) of a buffer of texts."""
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)))
    size = np.diff(off)
    nb = np.maximum(size, 1)
    kind = _KIND[raw]
    edges = off[:-1]
    full = size > 0
    at = edges[full]
    for k in range(_KINDS):
        if len(at):
            out[full, k] = np.add.reduceat(kind == k, at, dtype=np.int64) / nb[full]
    s, e, h, _, first = words(raw, off)
    count = np.diff(first)
    nw = np.maximum(count, 1)
    doc = np.repeat(np.arange(n), count)
    j = _KINDS
    out[:, j] = np.log1p(count)
    out[:, j + 1] = np.bincount(doc, e - s, n) / nw
    # distinct words of each run of 64: doesn't fall with the length of the text
    place = np.arange(len(doc)) - first[:-1][doc]
    chunk, inside = np.unique(doc * (1 << 32) + place // 64, return_inverse=True) if len(doc) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    d, _ = _runs(inside, h)
    out[:, j + 2] = np.bincount(chunk >> 32, np.bincount(d, minlength=len(chunk)), n) / nw if len(chunk) else 0
    for k in (1, 2):
        same = (h[k:] == h[:-k]) & (doc[k:] == doc[:-k])
        out[:, j + 2 + k] = np.bincount(doc[k:][same], minlength=n) / nw
    d, c = _runs(doc, h)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d, c)
    out[:, j + 5] = top / nw
    # lines: the sum of their word hashes stands for their words
    brk = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(kind == 5, out=brk[1:])
    line = brk[s] + doc
    new = np.ones(len(line), bool)
    new[1:] = line[1:] != line[:-1]
    start = np.flatnonzero(new)
    sums = np.add.reduceat(h, start) if len(start) else np.zeros(0, np.uint64)
    lines = np.bincount(doc[start], minlength=n)
    nl = np.maximum(lines, 1)
    d, c = _runs(doc[start], sums)
    out[:, j + 6] = np.log1p(lines)
    out[:, j + 7] = count / nl
    out[:, j + 8] = 1 - np.bincount(d, minlength=n) / nl * (lines > 0)
    up = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(kind == 2, out=up[1:])
    low = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(kind == 1, out=low[1:])
    u, lo = up[e] - up[s], low[e] - low[s]
    shout = (u >= 2) & (lo == 0)
    out[:, j + 9] = np.bincount(doc[shout], minlength=n) / nw
    out[:, j + 10] = np.bincount(doc[shout], (e - s)[shout], n) / nb
    return out


@dataclass
class Model:
    """cuts: (features, bins - 1) ascending; weights: (features, bins)."""

    cuts: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def place(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + self.weights[np.arange(x.shape[1])[None, :], self.place(x)].sum(axis=1)
        return 1 / (1 + np.exp(-z))


def _fit(pos: np.ndarray, unl: np.ndarray, shape: tuple[int, int], prior: float | None, l2: float, steps: int, rate: float = 0.1):
    """Weights and bias over binned rows. prior None: plain positives against unlabelled, of equal weight."""
    f, bins = shape
    flat = lambda b: b + np.arange(f) * bins
    p, u = flat(pos), flat(unl)
    w = np.zeros(f * bins + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-z))

    def spread(idx, r):
        return np.append(np.bincount(idx.ravel(), np.repeat(r, f), f * bins), r.sum())

    for t in range(1, steps + 1):
        zp, zu = w[p].sum(axis=1) + w[-1], w[u].sum(axis=1) + w[-1]
        if prior is None:
            g = spread(p, -sig(-zp) / len(p)) + spread(u, sig(zu) / len(u))
        else:
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            unbiased = spread(u, sig(zu) / len(u)) - prior * spread(p, sig(zp) / len(p))
            # where the estimated risk of negatives is below zero, step back (the method's correction)
            g = prior * spread(p, -sig(-zp) / len(p)) + unbiased if negative >= 0 else -unbiased
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1].reshape(f, bins), float(w[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores of rows the scorer hasn't seen.

    Where a score has few unlabelled below it that positives don't explain, 1 - prior is at least the rest: prior is
    the least, over all thresholds c, of P_U(score >= c) / P_P(score >= c), with a margin for small samples.
    """
    if not len(p) or not len(u):
        return 1.0
    c = np.unique(np.concatenate([p, u]))
    qp = 1 - np.searchsorted(np.sort(p), c, "left") / len(p)
    qu = 1 - np.searchsorted(np.sort(u), c, "left") / len(u)
    eps = np.sqrt(np.log(4 / confidence) / 2 / len(u)) + np.sqrt(np.log(4 / confidence) / 2 / len(p))
    ok = qp > 0.01
    best = np.argmin((qu[ok] + eps) / qp[ok])
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.01, 0.99))


def train(pos: np.ndarray, unl: np.ndarray, bins: int = 24, l2: float = 1e-7, steps: int = 2000, blind: float = 0.5) -> Model:
    """Fit on descriptions of positives and unlabelled rows."""
    f = len(NAMES)
    if not len(pos) or not len(unl):
        return Model(np.zeros((f, 0)), np.zeros((f, 1)), float(np.log(blind / (1 - blind))), blind)
    at = np.linspace(0, 1, bins + 1)[1:-1]
    cuts = np.quantile(unl, at, axis=0).T
    # a tail that most rows don't reach would share their bin: cut the rows beyond the most frequent value as well
    tails = [np.quantile(x, np.linspace(0, 1, 8)[1:-1]) if len(x := unl[unl[:, k] > cuts[k, bins // 2], k]) else np.full(6, cuts[k, -1]) for k in range(f)]
    cuts = np.sort(np.concatenate([cuts, np.array(tails)], axis=1), axis=1)
    model = Model(cuts, np.zeros((f, cuts.shape[1] + 1)), 0.0, blind)
    bp, bu = model.place(pos), model.place(unl)
    ip, iu = np.arange(len(pos)) % 2 == 0, np.arange(len(unl)) % 2 == 0
    sp, su = [], []
    for a, b in ((True, False), (False, True)):
        w, c = _fit(bp[ip == a], bu[iu == a], model.weights.shape, None, 1e-3, 200)
        k = np.arange(f)
        sp.append(w[k, bp[ip == b]].sum(axis=1) + c)
        su.append(w[k, bu[iu == b]].sum(axis=1) + c)
    model.prior = estimate_prior(np.concatenate(sp), np.concatenate(su))
    model.weights, model.bias = _fit(bp, bu, model.weights.shape, model.prior, l2, steps)
    return model


def described(docs: DataFrame) -> DataFrame:
    """doc_id and x, the description of its text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            x = describe(*text_buffer(b.column("text")))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], names=["doc_id", "x"])

    ship(docs.sparkSession)
    return docs.mapInArrow(rows, "doc_id long, x array<double>")


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, positives: int = 8000, unlabelled: int = 8000, **options) -> Model:
    """labels: doc_id, label (0 or 1), of the rows that may be learnt from. `positives` and `unlabelled` bound the rows collected."""
    order = F.xxhash64("doc_id", F.lit(11))
    trusted = labels.where("label is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("label").alias("label"))
    trusted = trusted.where("label = 1").orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(True).alias("pos"))
    ids = plain(docs).where("doc_id is not null").select("doc_id").orderBy(order, "doc_id").limit(unlabelled).distinct().withColumn("unl", F.lit(True))
    chosen = trusted.join(ids, "doc_id", "full")  # at most positives + unlabelled rows
    rows = plain(docs).join(F.broadcast(chosen), "doc_id")
    got = described(rows.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id").select("x", "pos", "unl", "doc_id").orderBy(F.xxhash64("doc_id", F.lit(23)), "x").limit(4 * (positives + unlabelled)).toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    have = lambda c: got[c].is_valid().to_numpy()
    return train(x[have("pos")], x[have("unl")], **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            s = model.score(describe(*text_buffer(b.column("text"))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    ship(docs.sparkSession)
    return plain(docs).mapInArrow(rows, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores at least `least`."""
    from .common import where_score

    return where_score(docs, lambda raw, off: model.score(describe(raw, off)) >= least)
