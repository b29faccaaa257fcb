import pytest
from pyspark.sql import functions as F

from quern.functions import docmeta as D


def one(spark, *cols):
    return spark.range(1).select(*cols).head()


@pytest.mark.parametrize("name, ext", [("a/b\\C.PY", "py"), ("Dockerfile", "dockerfile"), (".gitignore", ".gitignore"), ("x.tar.gz", "gz"), ("dir.d/file", "file"), ("end.", ""), ("", "")])
def test_extension(spark, name, ext):
    assert one(spark, D.extension_of(F.lit(name)))[0] == ext


@pytest.mark.parametrize("text, want", [
    ("octocat", ("user", None, None, "octocat")), (" own/repo ", ("repo", "own", "repo", None)), ("https://github.com/own/repo.git", ("repo", "own", "repo", None)),
    ("HTTP://GITHUB.com/own/repo/tree/main", ("repo", "own", "repo", None)), ("//", ("user", None, None, "")),
])
def test_repo_target(spark, text, want):
    assert tuple(one(spark, *D.repo_target(F.lit(text)))) == want


def fields(**k):
    return {n: F.lit(v).cast("string") for n, v in k.items()}


@pytest.mark.parametrize("doc, title, badge, mode, language", [
    ({"source": "wikipedia", "title": "T"}, "T", "wiki", "text", None), ({"source": "wikipedia"}, "Article", "wiki", "text", None),
    ({"source": "github", "type": "file", "repo": "r", "path": "a.rs"}, "r/a.rs", "github file", "code", "rs"), ({"source": "github", "fullName": "o/r"}, "o/r", "github repo", "repo", None),
    ({"type": "pdf"}, "document.pdf", "pdf", "pdf", None), ({"filename": "x.md", "content": "c"}, "x.md", "file", "markdown", None), ({"filename": "x.json"}, "x.json", "file", "json", None),
    ({"content": "c"}, "Document", "json", "text", None), ({"name": "n"}, "n", "json", "json", None),
])
def test_describe_and_mode(spark, doc, title, badge, mode, language):
    f = fields(**doc)
    assert tuple(one(spark, *D.describe(f), *D.render_mode(f))) == (title, badge, mode, language)


def test_texts(spark):
    assert one(spark, D.primary_text(fields(content="  \n", body="b", text="t")))[0] == "b"
    assert one(spark, D.primary_text({}))[0] == ""
    assert one(spark, D.snippet(fields(text="a  b\n c "), F.lit("{}")), D.snippet(fields(text=" "), F.lit('{"k": 1}')))[:] == ("a b c", '{"k": 1}')
    assert one(spark, D.snippet(fields(text="x" * 219 + " " + "y" * 9)))[0] == "x" * 219 + D.ELLIPSIS


def test_preview(spark):
    d = spark.createDataFrame([("x" * 300, "s", 1), ("y", None, 2)], "a string, b string, n int")
    rows = D.preview(d).collect()
    assert rows[0].a == "x" * 280 + D.ELLIPSIS and rows[0]["_truncated"] and rows[1].a == "y" and rows[1]["_truncated"] is None and rows[0].n == 1


def test_typed_fields(spark):
    j = F.lit('{"url": "u", "language": "", "pages": 3, "path": 7, "pageid": "7"}')
    facts = one(spark, D.fact_bar(j, F.lit("id1")))[0]
    assert [(f.name, f.value) for f in facts] == [("url", "u"), ("pages", "3"), ("id", "id1")]
    assert one(spark, D.number_field(j, "pageid"), D.number_field(j, "pages"))[:] == (None, 3.0)


def test_paragraphs(spark):
    d = spark.createDataFrame([(1, "a\nb\n \n\n  \n\nc")], "doc_id int, text string")
    assert [(r.nth, r.paragraph) for r in D.paragraphs(d).collect()] == [(0, "a b"), (1, "c")]


@pytest.mark.parametrize("raw, want", [(None, 10), ("5", 5), ("7abc", 7), ("abc", 10), ("0", 10), ("-3", 10), ("1000", 100), (" 12", 12)])
def test_limit(raw, want):
    assert D.clamp_limit(raw) == want
