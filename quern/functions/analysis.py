"""Text analysis as Column expressions, and the same rules in plain Python for query strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

STOPWORDS = tuple(sorted(
    """a about am an and are as at be been being but by did do does for from had has have he here i if in is it its
    no not of on or she so than that the then there these they this those to was we were with you""".split()
))
_SEPARATOR = "[^a-z0-9]+"


def stem(token: Column) -> Column:
    """The first suffix rule that applies; see `stem_word`."""
    n = F.length(token)
    less = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when(n <= 3, token)
        .when(token.endswith("ing") & (n > 5), less(3))
        .when(token.endswith("edly"), less(4))
        .when(token.endswith("ed") & (n > 4), less(2))
        .when(token.endswith("ies") & (n > 4), F.concat(less(3), F.lit("y")))
        .when(token.endswith("es") & (n > 4), less(2))
        .when(token.endswith("s") & ~token.endswith("ss"), less(1))
        .otherwise(token)
    )


def pieces(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits in lower case; empty strings may be among them."""
    return F.split(F.lower(text), _SEPARATOR)


def is_word(piece: Column) -> Column:
    return (piece != "") & ~piece.isin(*STOPWORDS)


def tokenize(text: Column) -> Column:
    """Stems of the words of a text, in order, with repetitions; null counts as empty."""
    return F.transform(F.filter(F.coalesce(pieces(text), F.array().cast("array<string>")), is_word), stem)


def stem_word(w: str) -> str:
    n = len(w)
    if n <= 3:
        return w
    for suffix, least, cut, add in (("ing", 6, 3, ""), ("edly", 4, 4, ""), ("ed", 5, 2, ""), ("ies", 5, 3, "y"), ("es", 5, 2, "")):
        if w.endswith(suffix) and n >= least:
            return w[: n - cut] + add
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def tokenize_text(text: str | None) -> list[str]:
    """`tokenize` on the driver, for queries."""
    return [stem_word(w) for w in re.split(_SEPARATOR, (text or "").lower()) if w and w not in STOPWORDS]


def query_terms(query: str | None) -> list[str]:
    """Distinct terms of a query in order."""
    return list(dict.fromkeys(tokenize_text(query)))


# leaves of JSON

_ESCAPE = r"\\(?:u[0-9a-fA-F]{4}|.)"
_LEAF = r'"[^"]*"\s*:?|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false'


def number_text(x: Column) -> Column:
    """A JSON number as JavaScript prints it, for doubles that Spark prints with an exponent or `.0`."""
    d = x.try_cast("double")
    plain = F.regexp_replace(F.regexp_replace(d.cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    far = F.regexp_replace(F.regexp_replace(F.lower(d.cast("string")), r"\.0e", "e"), r"e(\d)", r"e+$1")
    return F.when(x.rlike(r"\d[eE]|\.0$"), F.when((F.abs(d) < 1e21) & ((F.abs(d) >= 1e-6) | (d == 0)), plain).otherwise(far)).otherwise(x)


def json_text(json: Column) -> Column:
    """Strings, numbers and booleans of a JSON text at any depth, joined by spaces: what is indexed of a schema-less
    document. Keys and nulls don't count; invalid JSON: null.

    The text is brought to canonical form first (the last of equal keys wins where
    spark.sql.variant.allowDuplicateKeys is set); there all escapes stand for characters that separate words, so they
    become spaces, and the leaves are found by one regular expression without recursion: depth is unlimited.
    """
    canonical = F.regexp_replace(F.to_json(F.try_parse_json(json)), _ESCAPE, " ")
    found = F.filter(F.regexp_extract_all(canonical, F.lit(_LEAF), F.lit(0)), lambda x: ~x.endswith(":"))
    return F.array_join(F.transform(found, lambda x: F.when(x.startswith('"'), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(number_text(x))), " ")


# highlighting

_PLAIN = r"[^a-z0-9]+"


def highlight_terms(query: Column) -> Column:
    """Distinct words of at least two letters of a query, at most twelve; neither stopped nor stemmed."""
    words = F.filter(F.split(F.lower(query), _PLAIN), lambda w: F.length(w) >= 2)
    return F.slice(F.array_distinct(F.coalesce(words, F.array().cast("array<string>"))), 1, 12)


def highlight_terms_of(query: str | None) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(_PLAIN, (query or "").lower()) if len(w) >= 2))[:12]


def highlight_pattern(terms: list[str]) -> str:
    """Words that begin with a term; word limits are ASCII, whatever the engine's own."""
    return "(?i)(?<![A-Za-z0-9_])(?:" + "|".join(map(re.escape, terms)) + ")[A-Za-z0-9_]*"


def highlight(text: Column, query: str | None) -> Column:
    terms = highlight_terms_of(query)
    return F.regexp_replace(text, highlight_pattern(terms), "<mark>$0</mark>") if terms else text


def highlight_count(text: Column, query: str | None) -> Column:
    terms = highlight_terms_of(query)
    return (F.regexp_count(text, F.lit(highlight_pattern(terms))) if terms else F.lit(0)).cast("long")


def base64_text(x: Column) -> Column:
    """Base64 (line ends allowed) as UTF-8 text; bad bytes become U+FFFD, bad base64 null."""
    return F.make_valid_utf8(F.try_to_binary(F.regexp_replace(x, r"\s+", ""), F.lit("base64")).cast("string"))


def register(spark: SparkSession) -> None:
    """SQL functions quern_stem, quern_tokenize, quern_idf and quern_bm25, which Catalyst inlines."""
    stops = ", ".join(f"'{w}'" for w in STOPWORDS)
    rule = """CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ing' AND length(w) > 5 THEN left(w, length(w) - 3)
        WHEN w LIKE '%edly' THEN left(w, length(w) - 4) WHEN w LIKE '%ed' AND length(w) > 4 THEN left(w, length(w) - 2)
        WHEN w LIKE '%ies' AND length(w) > 4 THEN concat(left(w, length(w) - 3), 'y') WHEN w LIKE '%es' AND length(w) > 4 THEN left(w, length(w) - 2)
        WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END"""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION quern_stem(w STRING) RETURNS STRING RETURN {rule}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION quern_tokenize(t STRING) RETURNS ARRAY<STRING> RETURN transform(filter(coalesce(split(lower(t), '{_SEPARATOR}'), array()), p -> p <> '' AND p NOT IN ({stops})), w -> {rule})")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quern_idf(n DOUBLE, df DOUBLE) RETURNS DOUBLE RETURN ln((n - df + 0.5D) / (df + 0.5D) + 1D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quern_bm25(tf DOUBLE, idf DOUBLE, len DOUBLE, avgdl DOUBLE, k1 DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN idf * (tf * (k1 + 1D)) / (tf + k1 * (1D - b + b * len / avgdl))")
