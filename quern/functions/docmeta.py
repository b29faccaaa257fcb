"""What a document is called, how it is shown, and short forms of it, as Columns over its fields.

A document's fields are given as a mapping of names to Columns; absent fields count as null. `fields_of` makes one from
a table's own columns, `fields_of_json` from schema-less JSON.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELLIPSIS = "…"
_TEXTS = ("content", "readme", "body", "text", "description")
MARKDOWN = ("markdown", "md")
CODE = tuple(sorted(
    """bash c cc cjs conf cpp cs css dockerfile go graphql h hpp html ini java js jsx kt mjs php py rb rs scala scss
    sh sql svelte swift toml ts tsx vue xml yaml yml zsh""".split()
))
TEXT = tuple(sorted({*CODE, *MARKDOWN, *"csv env gitignore json jsonl lock log makefile ndjson rtf tsv txt".split()}))


def fields_of(docs: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in docs.columns}


def fields_of_json(json: Column, *names: str) -> dict[str, Column]:
    """Fields of JSON objects as strings, null unless the value is a string."""
    v = F.try_parse_json(json)
    return {n: F.when(F.schema_of_variant(F.variant_get(v, f"$.{n}", "variant")) == "STRING", F.try_variant_get(v, f"$.{n}", "string")) for n in names}


def number_field(json: Column, name: str) -> Column:
    """A field only if it is a number: a string of digits isn't one."""
    v = F.try_parse_json(json)
    return F.when(F.schema_of_variant(F.variant_get(v, f"$.{name}", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, f"$.{name}", "double"))


def _get(fields: Mapping[str, Column], name: str) -> Column:
    return fields.get(name, F.lit(None).cast("string"))


def trim(x: Column) -> Column:
    """Without any white space at either end, Unicode's included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def trim_end(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+$", "")


def collapse(x: Column) -> Column:
    return trim(F.regexp_replace(x, r"(?U)\s+", " "))


def extension_of(filename: Column) -> Column:
    """Of the last path component in lower case: what follows its last dot, or all of it without a dot beyond the first place."""
    base = F.regexp_extract(F.lower(filename), r"([^/\\]*)$", 1)
    return F.when(base.rlike(r"^.+\."), F.regexp_extract(base, r"([^.]*)$", 1)).otherwise(base)


def shorten(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(trim_end(F.left(x, F.lit(most))), F.lit(ELLIPSIS))).otherwise(x)


def preview(docs: DataFrame, most: int = 280) -> DataFrame:
    """Top-level strings cut to `most` characters; `_truncated` true where any was, else null."""
    strings = [c for c, kind in docs.dtypes if kind == "string"]
    cut = F.greatest(*[F.coalesce(F.length(c) > most, F.lit(False)) for c in strings]) if len(strings) > 1 else F.coalesce(F.length(strings[0]) > most, F.lit(False)) if strings else F.lit(False)
    return docs.select(*[shorten(F.col(c), most).alias(c) if c in strings else F.col(c) for c in docs.columns], F.when(cut, True).alias("_truncated"))


def primary_text(fields: Mapping[str, Column]) -> Column:
    """The first of the text fields that isn't blank, else an empty string."""
    have = [fields[c] for c in _TEXTS if c in fields]
    return F.coalesce(*[F.when(trim(c) != "", c) for c in have], F.lit(""))


def snippet(fields: Mapping[str, Column], whole: Column | None = None, most: int = 220) -> Column:
    """One line of the primary text, or of the whole document as JSON."""
    text = primary_text(fields)
    raw = text if whole is None else F.when(text != "", text).otherwise(whole)
    return shorten(collapse(raw), most)


def line(text: Column, most: int = 220) -> Column:
    """One line of a text itself, null if it is null: ASCII white space as one space, then spaces of any kind off both ends."""
    x = F.regexp_replace(F.regexp_replace(text, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")
    return F.when(F.length(x) > most, F.concat(F.regexp_replace(F.left(x, F.lit(most)), r"[\t\n\f\r ]+\z", ""), F.lit(ELLIPSIS))).otherwise(x)


def describe(fields: Mapping[str, Column]) -> tuple[Column, Column]:
    """Title and badge."""
    g = lambda n: _get(fields, n)
    wiki, hub, file, pdf, named = g("source") == "wikipedia", g("source") == "github", g("type") == "file", g("type") == "pdf", g("filename").isNotNull()
    text = lambda c: F.coalesce(c, F.lit("undefined"))
    title = (
        F.when(wiki, F.coalesce(g("title"), F.lit("Article")))
        .when(hub & file, F.concat(text(g("repo")), F.lit("/"), text(g("path"))))
        .when(hub, F.coalesce(g("fullName"), g("repo"), F.lit("repo")))
        .when(pdf, F.coalesce(g("filename"), F.lit("document.pdf")))
        .when(named, g("filename"))
        .otherwise(F.coalesce(g("title"), g("name"), F.lit("Document")))
    )
    badge = F.when(wiki, "wiki").when(hub & file, "github file").when(hub, "github repo").when(pdf, "pdf").when(named, "file").otherwise("json")
    return title, badge


def render_mode(fields: Mapping[str, Column]) -> tuple[Column, Column]:
    """How a document is shown, and the language of code."""
    g = lambda n: _get(fields, n)
    ext = extension_of(F.coalesce(g("path"), g("filename"), F.lit("")))
    hub_file = (g("source") == "github") & F.coalesce(g("type") == "file", F.lit(False))
    hub_repo = (g("source") == "github") & ~F.coalesce(g("type") == "file", F.lit(False))
    mode = (
        F.when(g("source") == "wikipedia", "text").when(hub_repo, "repo").when(g("type") == "pdf", "pdf").when(hub_file, "code")
        .when(ext.isin(*MARKDOWN), "markdown").when(ext == "json", "json").when(ext.isin(*CODE), "code")
        .when(g("content").isNotNull(), "text").otherwise("json")
    )
    return mode, F.when(mode == "code", ext)


def fact_bar(json: Column, doc_id: Column) -> Column:
    """Typed facts as an array of (name, value)."""
    f = fields_of_json(json, "url", "language", "path")
    pages = number_field(json, "pages")
    pair = lambda n, v, when: F.when(when, F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")))
    return F.array_compact(F.array(
        pair("url", f["url"], f["url"].isNotNull()), pair("language", f["language"], f["language"] != ""), pair("pages", F.when(pages == F.floor(pages), F.floor(pages).cast("string")).otherwise(pages.cast("string")), pages.isNotNull()),
        pair("path", f["path"], f["path"].isNotNull()), F.struct(F.lit("id").alias("name"), doc_id.cast("string").alias("value")),
    ))


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, nth (from 0 among those kept) and text of each paragraph: parts between blank lines, on one line, blank ones left out."""
    kept = F.filter(F.split(F.col(text), r"(?U)\n\s*\n"), lambda p: trim(p) != "")
    return docs.select("doc_id", F.posexplode(F.transform(kept, collapse)).alias("nth", "paragraph"))


def repo_target(text: Column) -> tuple[Column, Column, Column, Column]:
    """kind, owner, repo, user of a user name, `owner/repo` or address."""
    x = F.regexp_replace(trim(text), r"(?i)^https?://github\.com/", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^/+|/+$", ""), r"(?i)\.git$", "")
    parts = F.filter(F.split(x, "/"), lambda p: p != "")
    many = F.size(parts) >= 2
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return F.when(many, "repo").otherwise("user"), F.when(many, at(1)), F.when(many, at(2)), F.when(~many, F.coalesce(at(1), F.lit("")))


def repo_doc(r: Mapping[str, Column]) -> Column:
    """The document of a repository as JSON, from its listing; a blank readme is left out."""
    return F.to_json(F.struct(
        F.lit("github").alias("source"), r["name"].alias("repo"), r["full_name"].alias("fullName"), F.coalesce(r["description"], F.lit("")).alias("description"),
        F.coalesce(r["language"], F.lit("")).alias("language"), F.coalesce(r["topics"], F.array().cast("array<string>")).alias("topics"), r["stargazers_count"].alias("stars"),
        r["forks_count"].alias("forks"), r["html_url"].alias("url"), r["updated_at"].alias("updatedAt"), r["private"].alias("private"), F.nullif(trim(r["readme"]), F.lit("")).alias("readme"),
    ))


def clamp_limit(raw: str | None, fallback: int = 10, most: int = 100) -> int:
    """A page size from text: its leading integer, `fallback` for none or for less than 1, at most `most`."""
    import re

    m = re.match(r"\s*([+-]?\d+)", raw if raw is not None else str(fallback))
    n = int(m[1]) if m else 0
    return fallback if n <= 0 else min(n, most)
