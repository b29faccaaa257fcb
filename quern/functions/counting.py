"""Term counts of whole batches of documents at once: the rules of `analysis.tokenize` over Arrow buffers.

A batch's bytes are classed by one table, words are cut from them as one string array, and only its distinct words are
stemmed. The same rules as Columns touch each word by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..plans.shared import ship
from .analysis import STOPWORDS

_CLASS = np.zeros(256, np.uint8)  # a byte of a word in lower case, else 0
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _CLASS[_c] = _CLASS[ord(chr(_c).upper())] = _c
#: The letters beyond ASCII whose lower case begins with an ASCII letter.
_FOLDS = "K".encode(), "İ".encode()
_STOPS = pa.array(STOPWORDS)
#: Bytes of text that are counted together, and rows sent together.
_BYTES, _ROWS = 4 << 20, 1 << 17


def _buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets; null counts as empty."""
    text = text.cast(pa.large_string()).fill_null("")
    _, offsets, data = text.buffers()
    if not len(text) or data is None or not data.size:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(text) + 1, text.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _strings(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _stems(words: pa.Array) -> pa.Array:
    """`analysis.stem` of each word."""
    data, at = _buffer(words)
    data, at, n = data.copy(), at[:-1], np.diff(at)
    last = lambda k: np.where(n >= k, data[np.maximum(at + n - k, 0)], 0)
    a, b, c, d = last(1), last(2), last(3), last(4)
    s, es = a == ord("s"), (a == ord("s")) & (b == ord("e"))
    ed = (a == ord("d")) & (b == ord("e"))
    ies = es & (c == ord("i")) & (n > 4)
    rules = [n <= 3, (a == ord("g")) & (b == ord("n")) & (c == ord("i")) & (n > 5), (a == ord("y")) & (b == ord("l")) & (c == ord("d")) & (d == ord("e")), ed & (n > 4), ies, es & (n > 4), s & (b != ord("s"))]
    cut = np.select(rules, [0, 3, 4, 2, 2, 2, 1], 0)
    data[(at + n - 3)[ies]] = ord("y")
    inside = np.arange(len(data)) - np.repeat(at, n)
    return _strings(n - cut, data[inside < np.repeat(n - cut, n)])


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Each word in lower case, and how many each text has."""
    data, at = _buffer(text)
    if any(x in data.tobytes() for x in _FOLDS):
        data, at = _buffer(pa.array([(x or "").lower() for x in text.to_pylist()], pa.large_string()))
    low = _CLASS[data]
    inside = low != 0
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = at[(at > 0) & (at < len(low))]
    before[edges] = after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return _strings(ends - starts, low[inside]), np.diff(np.searchsorted(starts, at))


def count(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms in order; for each term of each text, by term and text: the term's place, the text's, how often; tokens of each text."""
    words, n = _words(text)
    coded = words.dictionary_encode()
    known = coded.dictionary
    stems = _stems(known).dictionary_encode()
    ordered = pc.sort_indices(stems.dictionary)
    rank = np.empty(len(ordered), np.int64)
    rank[ordered.to_numpy(zero_copy_only=False)] = np.arange(len(ordered))
    to = np.where(pc.is_in(known, value_set=_STOPS).to_numpy(zero_copy_only=False), -1, rank[stems.indices.to_numpy(zero_copy_only=False)])
    term, doc = to[coded.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(len(text)), n)
    term, doc = term[term >= 0], doc[term >= 0]
    places, tf = np.unique(term * len(text) + doc, return_counts=True)
    return stems.dictionary.take(ordered), places // max(len(text), 1), places % max(len(text), 1), tf, np.bincount(doc, minlength=len(text))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut by rows to about `_BYTES` of text; a row is never cut."""
    for b in batches:
        at, i = _buffer(b.column("text"))[1], 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + _BYTES, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def _columns(docs: DataFrame, text: Column | str) -> tuple[DataFrame, StructField]:
    ship(docs.sparkSession)
    return docs.select("doc_id", (F.col(text) if isinstance(text, str) else text).cast("string").alias("text")), docs.schema["doc_id"]


def counts(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """term, doc_id, tf, len: a row for each term of each row of `docs`, counted where it is read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            terms, term, doc, tf, length = count(b.column("text"))
            for i in range(0, len(tf), _ROWS):
                t, d, f = term[i : i + _ROWS], doc[i : i + _ROWS], tf[i : i + _ROWS]
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(t)), b.column("doc_id").take(pa.array(d)), pa.array(f, pa.int64()), pa.array(length[d], pa.int64())], ["term", "doc_id", "tf", "len"])

    own, key = _columns(docs, text)
    return own.mapInArrow(rows, StructType([StructField("term", StringType()), key, StructField("tf", LongType()), StructField("len", LongType())]))


def lengths(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """doc_id, len: tokens of each row of `docs`, 0 included."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            words, n = _words(b.column("text"))
            doc = np.repeat(np.arange(b.num_rows), n)[~pc.is_in(words, value_set=_STOPS).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.bincount(doc, minlength=b.num_rows), pa.int64())], ["doc_id", "len"])

    own, key = _columns(docs, text)
    return own.mapInArrow(rows, StructType([key, StructField("len", LongType())]))


def few_counts(docs: DataFrame, terms: list[str], text: Column | str = "text") -> DataFrame:
    """doc_id, len, tf: of each row of `docs` its tokens and how often each of the few `terms` occurs, null where none does."""
    wanted = pa.array(terms, pa.string())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            found, term, doc, tf, length = count(b.column("text"))
            place = pc.index_in(found, value_set=wanted).fill_null(-1).to_numpy(zero_copy_only=False)[term]
            own = np.zeros((b.num_rows, len(terms)), np.int64)
            own[doc[place >= 0], place[place >= 0]] = tf[place >= 0]
            ends = np.cumsum(np.where(own.any(1), len(terms), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(own[own.any(1)].ravel()), mask=pa.array(~own.any(1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(length, pa.int64()), lists], ["doc_id", "len", "tf"])

    own, key = _columns(docs, text)
    return own.mapInArrow(rows, StructType([key, StructField("len", LongType()), StructField("tf", ArrayType(LongType()))]))
