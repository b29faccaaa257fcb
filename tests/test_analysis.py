import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import analysis as A

CASES = {
    "Hello, WORLD!": ["hello", "world"], "the cat and the dog": ["cat", "dog"], "foo\t\n  bar": ["foo", "bar"], "search search": ["search", "search"], "ipv4 h2o test123": ["ipv4", "h2o", "test123"],
    "running jumped cats berries boxes": ["runn", "jump", "cat", "berry", "box"], "class bus": ["class", "bus"], "edly reedly": ["", "re"], "bring string thing": ["bring", "str", "thing"], "need speed": ["need", "spe"],
    "ties goes classes": ["tie", "goe", "class"], "thes beings": ["the", "being"], "Café naïve": ["caf", "na", "ve"], "it's foo_bar 3.14 -5": ["s", "foo", "bar", "3", "14", "5"], "": [], "  \n": [], "the of": [],
}


def test_golden(spark):
    got = spark.createDataFrame([(t,) for t in CASES], "t string").select("t", A.tokenize(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == CASES
    assert {t: A.tokenize_text(t) for t in CASES} == CASES


def test_null_text(spark):
    assert spark.createDataFrame([(None,)], "t string").select(A.tokenize(F.col("t"))).head()[0] == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abdegins éŁ0_-.\n", max_size=30), min_size=1, max_size=60))
def test_column_is_python(spark, texts):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", A.tokenize(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: A.tokenize_text(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("json, words", [
    ('{"title": "Storage", "tags": ["Search", {"deep": "Grace"}], "meta": {"views": 42, "ok": true, "none": null}}', {"storage", "search", "grace", "42", "true"}),
    ('{"a\\"b": "x\\n\\"quoted: y\\"", "k": 1.0, "m": 1e2, "n": 1e21, "p": -0.5}', {"x", "quot", "y", "1", "100", "1e", "21", "0", "5"}),
    ('"plain"', {"plain"}), ("[1, [2, [3]]]", {"1", "2", "3"}), ("{}", set()),
])
def test_json_leaves(spark, json, words):
    got = spark.createDataFrame([(json,)], "j string").select(A.tokenize(A.json_text(F.col("j")))).head()[0]
    assert set(got) == words


def test_json_long_and_invalid(spark):
    long = '{"t": "' + "word\\n" * 50_000 + '"}'
    rows = spark.createDataFrame([(0, long), (1, "{broken"), (2, None)], "i int, j string").select("i", F.size(A.tokenize(A.json_text(F.col("j")))).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {0: 50_000, 1: 0, 2: 0}


def test_highlight(spark):
    d = spark.createDataFrame([("éstor stor Storage restore",)], "t string")
    assert d.select(A.highlight(F.col("t"), "stor")).head()[0] == "é<mark>stor</mark> <mark>stor</mark> <mark>Storage</mark> restore"
    assert d.select(A.highlight_count(F.col("t"), "stor"), A.highlight_count(F.col("t"), "")).head()[:] == (3, 0)
    assert A.highlight_terms_of("a The THE of x9 " + " ".join(f"w{i}" for i in range(20))) == ["the", "of", "x9", *[f"w{i}" for i in range(9)]]


def test_sql_functions(spark):
    A.register(spark)
    assert spark.sql("SELECT quern_tokenize('Running, the boxes'), quern_stem('berries'), round(quern_idf(2, 1), 6)").head()[:] == (["runn", "box"], "berry", 0.693147)


def test_base64(spark):
    d = spark.createDataFrame([("aGVs\nbG8=",), ("!!",)], "x string").select(A.base64_text(F.col("x")))
    assert [r[0] for r in d.collect()] == ["hello", None]
