import base64
import gzip
import hashlib
import io

import pytest

from quern.llm import warc
from quern.llm.queries import QUERIES

ROWS = [
    (1, "u", "x"), (2, "u", "x"), (3, None, None), (4, "a", ""), (5, "b", "yy\r\n\r\n" * 5000), (None, "q", "x"), (None, "q", "x"), (2, "u", "x"), (0, "é", "éé" * 10), (9, "é", "éé" * 10), (9, "e\r\nX: y", "\x1f" + "z" * 100),
    (10, "long", "abc" * 100_000),
]


def want(rows, least):
    first, key = {}, lambda i, p: (p is None, p or 0, i)
    digest = lambda h: hashlib.sha1((h or "").encode()).digest()
    for i, (p, _, h) in enumerate(rows):
        if len((h or "").encode()) >= least:
            first[digest(h)] = min(first.get(digest(h), key(i, p)), key(i, p))
    out = []
    for i, (p, _, h) in enumerate(rows):
        n = len((h or "").encode())
        again = n >= least and first[digest(h)] != key(i, p)
        at = first.get(digest(h))
        out.append((p, n, base64.b32encode(digest(h)).decode(), "revisit" if again else "response", (None if at[0] else at[1]) if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("least, split", [(0, 1 << 23), (10, 700), (0, 97)])
def test_round_trip(spark, least, split):
    d = spark.createDataFrame([(*r, "n") for r in ROWS], "page_id long, url string, html string, sha string").repartition(3)
    assert got(warc.archive(d, least, split_bytes=split)) == want(ROWS, least)


def test_unique_rows(spark):
    rows = [(i, f"u{i}", "same" if i % 3 == 0 else f"page {i}" * i) for i in range(60)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert got(warc.archive(d)) == want(rows, 0)
    full = {r.page_id: r for r in warc.archive(d, payload=True).collect()}
    assert all((full[i].payload is None) == (full[i].record_type == "revisit") for i in full) and bytes(full[5].payload).decode() == rows[5][2] and full[7].url == "u7"


def test_query_on_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert got(QUERIES["op5_warc"](spark, "/root/testdata/sf0.001")) == want(rows, 0)


def test_empty(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("step", [1, 50, 333, 10**6])
def test_every_record_has_one_owner(step):
    inner = gzip.compress(b"WARC/1.1 is only text here" * 9)
    bodies = [b"", b"\x1f\x8b\x08" * 400, b"text " * 500, bytes(range(256)) * 40, inner * 20]
    data = b"".join(warc.record("response", i, "u", b, len(b), "D", None) for i, b in enumerate(bodies * 3))
    seen = [(at, warc.parse(c)[2]) for s in range(0, len(data), step) for at, c in warc.members(io.BytesIO(data), s, min(len(data), s + step))]
    assert [p for _, p in seen] == bodies * 3 and len({a for a, _ in seen}) == len(seen)


def test_cut_record_is_told():
    data = warc.record("response", 1, "u", b"abc" * 1000, 3000, "D", None)
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(data[:-20]), 0, len(data)))
