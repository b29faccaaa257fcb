"""Remote sources: repositories and encyclopedia articles, as Python data sources over a pluggable transport.

A transport is a function from a URL and headers to (status, response headers, body), so the readers can be tested
without a network. The rules that decide what is kept are plain functions over tables and can be used by themselves.
"""

from __future__ import annotations

import base64
import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.docmeta import TEXT, extension_of

Transport = Callable[[str, dict[str, str]], tuple[int, dict[str, str], bytes]]
REPOS, FILES_EACH, FILES_ALL, FILE_BYTES, LEAST_EXTRACT = 100, 25, 400, 120_000, 40


def http(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:  # noqa: S310
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


class RemoteError(RuntimeError):
    pass


def wanted_files(entries: DataFrame, path: str = "path") -> DataFrame:
    """Tree entries (path, type, size) that are files of text of at most FILE_BYTES; an unknown size counts as 0."""
    return entries.where((F.col("type") == "blob") & (F.coalesce(F.col("size"), F.lit(0)) <= FILE_BYTES) & extension_of(F.col(path)).isin(*TEXT))


def within_budget(entries: DataFrame, repo: str = "repo", order: str = "nth", each: int = FILES_EACH, most: int = FILES_ALL) -> DataFrame:
    """The first `each` files of each repository, until `most` are taken over all in the order of the repositories."""
    nth = F.row_number().over(Window.partitionBy(repo).orderBy(order))
    first = entries.withColumn("place", nth).where(F.col("place") <= each)
    taken = first.groupBy(repo).agg(F.count("*").alias("files"))  # a row for each repository, of which a listing has REPOS at most
    before = F.coalesce(F.sum("files").over(Window.orderBy(repo).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = taken.select(repo, F.greatest(F.lit(0), F.least("files", F.lit(most) - before)).alias("take"))
    return first.join(room, repo).where(F.col("place") <= F.col("take"))


def articles(pages: DataFrame, count: int | None = None, order: str | None = None) -> DataFrame:
    """Pages (pageid, title, extract) of at least LEAST_EXTRACT characters, one for each pageid (the first by `order`), at most `count`."""
    kept = pages.where(F.length("extract") >= LEAST_EXTRACT)
    one = kept.dropDuplicates(["pageid"]) if order is None else kept.groupBy("pageid").agg(F.min_by(F.struct(*[c for c in kept.columns if c != "pageid"]), order).alias("r")).select("pageid", "r.*")
    one = one if order is None else one.orderBy(order)
    return one if count is None else one.limit(count)


def article_doc(title: Column, extract: Column, pageid: Column) -> Column:
    return F.to_json(F.struct(F.lit("wikipedia").alias("source"), F.lit("article").alias("type"), title.alias("title"), F.coalesce(extract, F.lit("")).alias("content"), F.concat(F.lit("https://en.wikipedia.org/?curid="), pageid.cast("string")).alias("url"), pageid.alias("pageid")))


class _Hub:
    """Calls to the repository host's REST interface."""

    def __init__(self, transport: Transport, token: str | None, base: str = "https://api.github.com"):
        self.transport, self.token, self.base = transport, token, base
        self.remaining: int | None = None

    def call(self, path: str, raw: bool = False) -> tuple[int, object]:
        headers = {"accept": "application/vnd.github.raw" if raw else "application/vnd.github+json", "user-agent": "quern"}
        if self.token:
            headers["authorization"] = f"Bearer {self.token}"
        status, got, body = self.transport(self.base + path, headers)
        left = {k.lower(): v for k, v in got.items()}.get("x-ratelimit-remaining")
        self.remaining = int(left) if left is not None else None
        if raw:
            return status, body.decode("utf-8", "replace")
        try:
            return status, json.loads(body)
        except ValueError:
            return status, None

    def fail(self, status: int, what: str, data: object) -> None:
        if status == 404:
            raise RemoteError(f"{what} not found")
        if status == 401:
            raise RemoteError("invalid access token")
        if status == 403:
            raise RemoteError("rate limit reached: add an access token to go on")
        raise RemoteError(f"error: {data.get('message') if isinstance(data, dict) else f'HTTP {status}'}")

    def repos(self, user: str, most: int = REPOS) -> list[dict]:
        from urllib.parse import quote

        path = f"/users/{quote(user, safe='')}/repos?per_page=100&sort=updated"
        if self.token:
            status, me = self.call("/user")
            if status == 200 and isinstance(me, dict) and str(me.get("login", "")).lower() == user.lower():
                path = "/user/repos?per_page=100&affiliation=owner&sort=updated"
        out: list[dict] = []
        page = 1
        while len(out) < most:
            status, data = self.call(f"{path}&page={page}")
            if status >= 400:
                self.fail(status, f'user "{user}"', data)
            if not isinstance(data, list) or not data:
                break
            out += data
            if len(data) < 100:
                break
            page += 1
        return out[:most]

    def repo(self, owner: str, name: str) -> dict:
        status, data = self.call(f"/repos/{owner}/{name}")
        if status >= 400:
            self.fail(status, f"repository {owner}/{name}", data)
        return data  # type: ignore[return-value]

    def document(self, r: dict) -> dict:
        status, readme = self.call(f"/repos/{r['full_name']}/readme", raw=True)
        doc = {
            "source": "github", "repo": r["name"], "fullName": r["full_name"], "description": r.get("description") or "", "language": r.get("language") or "", "topics": r.get("topics") or [],
            "stars": r.get("stargazers_count"), "forks": r.get("forks_count"), "url": r.get("html_url"), "updatedAt": r.get("updated_at"), "private": r.get("private"),
        }
        return doc | ({"readme": str(readme).strip()} if status < 400 and str(readme).strip() else {})

    def files(self, r: dict, most: int) -> Iterator[dict]:
        branch = r.get("default_branch", "main")
        status, tree = self.call(f"/repos/{r['full_name']}/git/trees/{branch}?recursive=1")
        entries = tree.get("tree") if status < 400 and isinstance(tree, dict) else None
        fits = [e for e in entries or [] if e["type"] == "blob" and (e.get("size") or 0) <= FILE_BYTES and file_extension(e["path"]) in TEXT]
        for e in fits[:most]:
            status, blob = self.call(f"/repos/{r['full_name']}/git/blobs/{e['sha']}")
            if status >= 400 or not isinstance(blob, dict) or not blob.get("content"):
                continue
            text = base64.b64decode(blob["content"]).decode("utf-8", "replace")
            if text.strip():
                yield {"source": "github", "type": "file", "repo": r["name"], "path": e["path"], "url": f"{r.get('html_url')}/blob/{branch}/{e['path']}", "content": text}


def file_extension(path: str) -> str:
    base = path.lower().replace("\\", "/").rsplit("/", 1)[-1]
    dot = base.rfind(".")
    return base if dot <= 0 else base[dot + 1 :]


class _Repo(InputPartition):
    def __init__(self, repo: dict, budget: int):
        self.repo, self.budget = repo, budget


class RepositoryReader(DataSourceReader):
    """A partition for each repository, so they are read side by side; the file budget is shared out beforehand."""

    def __init__(self, options: dict, transport: Transport):
        self.options, self.transport = options, transport

    def _hub(self) -> _Hub:
        return _Hub(self.transport, self.options.get("token") or None)

    def partitions(self) -> list[InputPartition]:
        o, hub = self.options, self._hub()
        deep = str(o.get("deep", "false")).lower() == "true"
        repos = [hub.repo(o["owner"], o["repo"])] if o.get("repo") else hub.repos(o["user"])
        left, out = FILES_ALL if deep else 0, []
        for r in repos:
            own = min(FILES_EACH, left)
            left -= own
            out.append(_Repo(r, own))
        return out

    def read(self, partition: _Repo) -> Iterator[tuple[str]]:
        hub = self._hub()
        yield (json.dumps(hub.document(partition.repo)),)
        if partition.budget:
            for d in hub.files(partition.repo, partition.budget):
                yield (json.dumps(d),)


class RepositorySource(DataSource):
    """`spark.read.format("quern_repos")` with options user, or owner and repo; token; deep. Subclass and override `transport` to test."""

    transport: Transport = staticmethod(http)

    @classmethod
    def name(cls) -> str:
        return "quern_repos"

    def schema(self) -> str:
        return "doc_json string"

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader(dict(self.options), type(self).transport)


ARTICLES = "https://en.wikipedia.org/w/api.php?action=query&format=json&formatversion=2&generator=random&grnnamespace=0&grnlimit=20&prop=extracts&exintro=1&explaintext=1&exlimit=20"


def fetch_pages(transport: Transport, sleep: Callable[[float], None] = time.sleep, tries: int = 6) -> list[dict]:
    """One request of random pages; 429 and 503 are retried after the time asked for, or a growing one."""
    for attempt in range(tries + 1):
        status, headers, body = transport(ARTICLES, {"user-agent": "quern"})
        if status not in (429, 503):
            break
        if attempt == tries:
            raise RemoteError(f"HTTP {status}")
        after = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
        sleep(float(after) if after.isdigit() and int(after) > 0 else min(0.5 * 2**attempt, 15) + random.random() * 0.4)  # noqa: S311
    if status >= 400:
        raise RemoteError(f"HTTP {status}")
    return json.loads(body).get("query", {}).get("pages", [])


class _Share(InputPartition):
    def __init__(self, count: int):
        self.count = count


class ArticleReader(DataSourceReader):
    """`count` pages shared out over 1 to 24 readers; duplicates between readers are left to `articles`."""

    def __init__(self, options: dict, transport: Transport):
        self.count, self.transport = int(options.get("count", 20)), transport
        self.readers = max(1, min(int(options.get("concurrency", 12)), 24))

    def partitions(self) -> list[InputPartition]:
        n = min(self.readers, max(1, self.count))
        return [_Share(self.count // n + (k < self.count % n)) for k in range(n)]

    def read(self, partition: _Share) -> Iterator[tuple[int, str, str]]:
        seen: set[int] = set()
        errors = 0
        while len(seen) < partition.count:
            try:
                pages, errors = fetch_pages(self.transport), 0
            except (RemoteError, OSError):
                errors += 1
                if errors > 25:
                    raise
                continue
            for p in pages:
                if len(seen) < partition.count and p["pageid"] not in seen and len(p.get("extract") or "") >= LEAST_EXTRACT:
                    seen.add(p["pageid"])
                    yield p["pageid"], p["title"], p.get("extract") or ""


class ArticleSource(DataSource):
    """`spark.read.format("quern_articles")` with options count and concurrency."""

    transport: Transport = staticmethod(http)

    @classmethod
    def name(cls) -> str:
        return "quern_articles"

    def schema(self) -> str:
        return "pageid long, title string, extract string"

    def reader(self, schema) -> DataSourceReader:
        return ArticleReader(dict(self.options), type(self).transport)
