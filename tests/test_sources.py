import base64
import json
import zlib

import pytest
from pyspark.sql import functions as F

from quern.sources import files, remote
from quern.sources.seed import Generator, corpus


def pdf(text, flate=False):
    body = f"BT /F1 24 Tf 72 720 Td ({text}) Tj ET".encode()
    if flate:
        body = zlib.compress(body)
    head = b"<< /Length %d %s>>" % (len(body), b"/Filter /FlateDecode " if flate else b"")
    return b"%PDF-1.4\n1 0 obj\n<< /Type /Pages /Kids [2 0 R] >>\nendobj\n2 0 obj\n<< /Type /Page >>\nendobj\n3 0 obj\n" + head + b"\nstream\n" + body + b"\nendstream\nendobj\n%%EOF"


def test_router(spark, tmp_path):
    for name, data in {
        "a.txt": b"text \xff!", "o.json": b'{"k": 1, "filename": "mine"}', "arr.json": b'[{"k": 1}, 2, [3]]', "none.json": b"[]", "bad.json": b"{nope", "l.ndjson": b'{"n": 1}\n\nbad\n 5 \n', "bad.jsonl": b"no json\n",
        "x.png": b"\x89PNG\x00\x00", "noext": b"hello", "empty.md": b" \n\t", "d.pdf": pdf("Hello \\(PDF\\)"), "z.pdf": pdf("Packed", True), "scan.pdf": pdf(""), "not.pdf": b"zzz",
    }.items():
        (tmp_path / name).write_bytes(data)
    got, report = files.documents(files.read_files(spark, str(tmp_path)))
    docs = {}
    for r in got.orderBy("filename", "nth").collect():
        docs.setdefault(r.filename, []).append(json.loads(r.doc_json))
    assert docs["a.txt"] == [{"filename": "a.txt", "content": "text �!"}]
    assert docs["o.json"] == [{"k": 1, "filename": "o.json"}]
    assert docs["arr.json"] == [{"k": 1, "filename": "arr.json"}, {"filename": "arr.json", "content": 2}, {"filename": "arr.json", "content": [3]}]
    assert docs["bad.json"] == [{"filename": "bad.json", "content": "{nope"}]
    assert docs["l.ndjson"] == [{"n": 1, "filename": "l.ndjson"}, {"filename": "l.ndjson", "content": 5}]
    assert docs["bad.jsonl"][0]["content"] == "no json\n" and docs["noext"][0]["content"] == "hello"
    assert docs["d.pdf"] == [{"filename": "d.pdf", "type": "pdf", "pages": 1, "content": "Hello (PDF)"}] and docs["z.pdf"][0]["content"] == "Packed"
    rep = {r.filename: (r.status, r.reason, r.documents) for r in report.collect()}
    assert rep["none.json"] == ("indexed", None, 0) and rep["empty.md"] == ("skipped", files.EMPTY, 0) and rep["x.png"] == ("skipped", files.BINARY, 0)
    assert rep["scan.pdf"] == ("skipped", files.SCANNED, 0) and rep["not.pdf"][0] == "skipped" and len(rep) == 14
    assert files.totals(report).head()[:] == (sum(r[2] for r in rep.values()), 10, 4)


@pytest.mark.parametrize("data, want", [(b"", False), (b"abc\n\t\r", False), (b"a\x00", True), (b"\x01\x02abc", True), (b"\x01" + b"a" * 9, False), (b"a" * 8192 + b"\x00", False)])
def test_binary(spark, data, want):
    assert spark.createDataFrame([(bytearray(data),)], "content binary").select(files.is_binary(F.col("content"))).head()[0] is want


def test_lines(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"n": 1}\n\n  \nbad\n{"n": 2}\n')
    assert files.read_ndjson(spark, str(tmp_path)).count() == 2
    assert files.count_lines(spark.read.text(str(tmp_path))).head()[0] == 3


def offline():
    """Made inside a function, so that it is pickled by value."""
    import base64
    import json

    def hub(url, headers):
        path = url.removeprefix("https://api.github.com")
        repo = lambda n: {"name": n, "full_name": f"o/{n}", "description": None, "language": "Py", "topics": ["t"], "stargazers_count": 1, "forks_count": 0, "html_url": f"https://h/o/{n}", "updated_at": "x", "private": False, "default_branch": "main"}
        tree = [{"path": f"f{i}.py", "type": "blob", "sha": f"s{i}", "size": i} for i in range(30)] + [{"path": "big.py", "type": "blob", "sha": "b", "size": 10**6}, {"path": "x.png", "type": "blob", "sha": "p"}, {"path": "d", "type": "tree", "sha": "d"}]
        if path.startswith("/users/o/repos"):
            return 200, {"X-RateLimit-Remaining": "9"}, json.dumps([repo("r"), repo("q")]).encode()
        if path == "/repos/o/r":
            return 200, {}, json.dumps(repo("r")).encode()
        if path == "/repos/o/r/readme":
            return 200, {}, b" # Hi \n"
        if path.endswith("/git/trees/main?recursive=1"):
            return 200, {}, json.dumps({"tree": tree}).encode()
        if "/git/blobs/" in path:
            text = b"   " if path.endswith("s3") else path.encode()
            return 200, {}, json.dumps({"content": base64.b64encode(text).decode()}).encode()
        return (401 if "bad" in path else 404), {}, b'{"message": "no"}'

    class Offline(remote.RepositorySource):
        transport = staticmethod(hub)

    return Offline


def test_repositories(spark):
    spark.dataSource.register(offline())
    read = lambda **o: [json.loads(r[0]) for r in spark.read.format("quern_repos").options(**o).load().collect()]
    flat = read(user="o")
    assert [d["fullName"] for d in flat] == ["o/r", "o/q"] and flat[0]["readme"] == "# Hi" and "readme" not in flat[1]
    deep = read(owner="o", repo="r", deep="true")
    assert len(deep) == 1 + 24 and deep[1] == {"source": "github", "type": "file", "repo": "r", "path": "f0.py", "url": "https://h/o/r/blob/main/f0.py", "content": "/repos/o/r/git/blobs/s0"}
    for user, word in (("zz", "not found"), ("bad", "invalid")):
        with pytest.raises(Exception, match=word):
            read(user=user)


def test_articles(spark):
    calls = []

    def flaky(url, headers):
        calls.append(1)
        return (429, {"Retry-After": "2"}, b"") if len(calls) < 3 else (200, {}, json.dumps({"query": {"pages": [{"pageid": 1, "title": "t", "extract": "x"}]}}).encode())

    waits = []
    assert remote.fetch_pages(flaky, waits.append)[0]["pageid"] == 1 and waits == [2.0, 2.0]
    with pytest.raises(remote.RemoteError):
        remote.fetch_pages(lambda u, h: (503, {}, b""), lambda s: None)
    p = spark.createDataFrame([(1, "a", "x" * 40, 0), (1, "b", "x" * 50, 1), (2, "c", "x" * 39, 2), (3, "d", None, 3), (4, "e", "y" * 60, 4)], "pageid long, title string, extract string, nth int")
    assert [(r.pageid, r.title) for r in remote.articles(p, order="nth").collect()] == [(1, "a"), (4, "e")]
    assert remote.articles(p, count=1, order="nth").count() == 1


def test_seed(spark):
    g = Generator()
    want = [g.document(i) for i in range(60)]
    assert [tuple(r) for r in corpus(spark, 60, block=7).orderBy("seq").collect()] == want
    assert len(want[0][1].split()) >= 20 and corpus(spark, 0).count() == 0
