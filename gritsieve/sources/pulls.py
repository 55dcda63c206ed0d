"""Merged pull requests as commits: from recorded responses, or over the network.

Recorded responses are one JSON file for each request. They are read as a DataFrame and everything
else is relational: the listing is cut at the watermark by a running minimum, rows seen before go by
an anti-join, the limit is a running count, and files and commits are joined by number. The live
client is a small paged reader behind the same row shapes, to be recorded first.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gritsieve.functions.measure import measured, unified_hunks
from gritsieve.functions.text import language_of, linked_issues, normalize_date, strip
from gritsieve.schema import COMMIT, FILE, HUNK, PATCH, PULL_REQUEST

API = "https://api.github.com"
MAX_FILES = 300
FIXTURE_VERSION = 1
REPO_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9-]*/[A-Za-z0-9._-]+$")
#: Statuses of files without counts and without a patch whose contents did not change (fixed values).
UNCHANGED = ("renamed", "copied", "changed", "unchanged")

_S, _L = T.StringType(), T.LongType()
FILE_ITEM = T.StructType([T.StructField("filename", _S), T.StructField("previous_filename", _S), T.StructField("status", _S), T.StructField("additions", _L), T.StructField("deletions", _L), T.StructField("patch", _S)])
COMMIT_ITEM = T.StructType([T.StructField("sha", _S), T.StructField("commit", T.StructType([T.StructField("message", _S)]))])
PULL_ITEM = T.StructType([
    T.StructField("number", _L), T.StructField("title", _S), T.StructField("body", _S), T.StructField("html_url", _S), T.StructField("merged_at", _S),
    T.StructField("merge_commit_sha", _S), T.StructField("updated_at", _S), T.StructField("labels", T.ArrayType(T.StructType([T.StructField("name", _S)]))),
    T.StructField("base", T.StructType([T.StructField("ref", _S), T.StructField("sha", _S)])), T.StructField("head", T.StructType([T.StructField("sha", _S)])),
])
_FIXTURE = T.StructType([
    T.StructField("format", _S), T.StructField("version", T.IntegerType()), T.StructField("key", _S),
    T.StructField("responses", T.ArrayType(T.StructType([T.StructField("status", T.IntegerType()), T.StructField("headers", T.MapType(_S, _S)), T.StructField("json", _S), T.StructField("text", _S)]))),
])


# --- recorded responses ------------------------------------------------------------------------


def read_responses(spark: SparkSession, folder: str) -> DataFrame:
    """(key, path, page, json) of the last good response to each recorded request."""
    raw = spark.read.schema(_FIXTURE).json(folder, multiLine=True, pathGlobFilter="*.json")
    good = F.filter("responses", lambda r: r["status"] == 200)
    url = F.regexp_extract("key", r"\A\S+ ([^?]*)", 1)
    page = F.coalesce(F.nullif(F.regexp_extract("key", r"[?&]page=(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return raw.where(F.size(good) > 0).select("key", url.alias("path"), page.alias("page"), F.element_at(good, -1)["json"].alias("json"))


def _items(responses: DataFrame, path: str, kind: T.StructType) -> DataFrame:
    """The items of a paged list in their order: the groups of ``path``, pos and the item."""
    pages = responses.where(F.col("path").rlike(path)).select("path", "page", F.posexplode(F.from_json("json", T.ArrayType(kind))).alias("at", "item"))
    return pages.select(F.regexp_extract("path", path, 1).alias("repo"), F.nullif(F.regexp_extract("path", path, 2), F.lit("")).cast("long").alias("number"), (F.col("page") * 100_000 + F.col("at")).alias("pos"), "item")


def listing(responses: DataFrame) -> DataFrame:
    return _items(responses, r"\A/repos/([^/]+/[^/]+)/pulls()\z", PULL_ITEM).drop("number")


def files(responses: DataFrame) -> DataFrame:
    return _items(responses, r"\A/repos/([^/]+/[^/]+)/pulls/(\d+)/files\z", FILE_ITEM)


def commits(responses: DataFrame) -> DataFrame:
    return _items(responses, r"\A/repos/([^/]+/[^/]+)/pulls/(\d+)/commits\z", COMMIT_ITEM)


# --- rows to commits ---------------------------------------------------------------------------


def file_changes(items: DataFrame) -> DataFrame:
    """``items`` (repo, number, pos, item) with the changed file of each.

    Without a patch: a rename or a mode change has an empty one, a file with counts is unmeasured,
    any other is binary. A patch whose lines do not add up to the counts was cut: unmeasured.
    """
    path, added, deleted = F.col("item.filename"), F.col("item.additions").cast("int"), F.col("item.deletions").cast("int")
    still = (added == 0) & (deleted == 0) & F.col("item.patch").isNull()
    none = F.array().cast(T.ArrayType(HUNK))
    hunks = F.when(F.col("item.patch").isNotNull(), unified_hunks(F.col("item.patch"))).when(still & F.col("item.status").isin(*UNCHANGED), none)
    parsed = items.withColumn("__hunks", hunks)
    lines = lambda side: F.aggregate("__hunks", F.lit(0), lambda n, h: n + F.size(h[side]))
    whole = F.when((lines("added") == added) & (lines("deleted") == deleted), F.col("__hunks"))
    binary = still & F.col("__hunks").isNull()
    patch = measured(whole, language_of(path)).cast(PATCH)
    file = F.struct(path.alias("path"), F.when(~binary, added).alias("added"), F.when(~binary, deleted).alias("deleted"), F.col("item.previous_filename").alias("old_path"), F.array().cast("array<string>").alias("signals"), patch.alias("patch")).cast(FILE)
    return parsed.select("repo", "number", "pos", file.alias("file"))


def pull_sha(pull: Column) -> Column:
    """The sha that a merged request's commit gets: the merge commit's, else the head's."""
    return F.coalesce(F.nullif(pull["merge_commit_sha"], F.lit("")), pull["head"]["sha"])


def merged(pulls: DataFrame, since: str | None = None, seen: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The requests of a listing (newest update first) that are to be read, with ``pos``.

    Repeated numbers count once; the listing stops at the first one not newer than ``since``; those
    seen before (a table of ``sha``) and those not merged are passed over; then the limit holds.
    """
    once = Window.partitionBy("repo", "item.number").orderBy("pos")
    rows = pulls.withColumn("__k", F.row_number().over(once)).where("__k = 1").drop("__k")
    order = Window.partitionBy("repo").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    if since is not None:
        rows = rows.withColumn("__open", F.min((F.col("item.updated_at") > since).cast("int")).over(order)).where("__open = 1").drop("__open")
    rows = rows.where(F.col("item.merged_at").isNotNull()).withColumn("sha", pull_sha(F.col("item")))
    if seen is not None:
        rows = rows.join(seen.select("sha").distinct(), "sha", "left_anti")
    if limit is not None:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("repo").orderBy("pos"))).where(F.col("__n") <= limit).drop("__n")
    return rows


def pull_commits(pulls: DataFrame, commit_items: DataFrame, file_items: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Merged requests as commits, newest merge first; those with more than ``max_files`` files are left out."""
    counts = file_items.groupBy("repo", "number").agg(F.count("*").alias("n"))
    few = file_items.join(counts.where(F.col("n") <= max_files).select("repo", "number"), ["repo", "number"], "left_semi")
    listed = file_changes(few).groupBy("repo", "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "file"))), lambda x: x["file"]).alias("files"))
    said = commit_items.groupBy("repo", "number").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("item.sha").alias("sha"), F.col("item.commit.message").alias("message")))).alias("said"))
    rows = pulls.withColumn("number", F.col("item.number")).join(counts.where(F.col("n") > max_files).select("repo", "number"), ["repo", "number"], "left_anti")
    rows = rows.join(listed, ["repo", "number"], "left").join(said, ["repo", "number"], "left")
    body = strip(F.replace(F.coalesce("item.body", F.lit("")), F.lit("\r\n"), F.lit("\n")))
    texts = F.concat(F.array(body), F.coalesce(F.transform("said", lambda x: x["message"]), F.array().cast("array<string>")))
    labels = F.coalesce(F.array_sort(F.array_distinct(F.transform("item.labels", lambda x: x["name"]))), F.array().cast("array<string>"))
    request = F.struct(
        F.col("number"), F.col("item.html_url").alias("url"), F.col("item.title").alias("title"), normalize_date(F.col("item.merged_at")).alias("merged_at"),
        F.col("item.base.ref").alias("base_ref"), F.col("item.base.sha").alias("base_sha"), F.col("item.head.sha").alias("head_sha"), F.nullif(F.col("item.merge_commit_sha"), F.lit("")).alias("merge_commit_sha"),
        labels.alias("labels"), linked_issues(texts, F.col("repo")).alias("linked_issues"), F.coalesce(F.transform("said", lambda x: x["sha"]), F.array().cast("array<string>")).alias("commits"),
    ).cast(PULL_REQUEST)
    message = F.concat(F.col("item.title"), F.when(body != "", F.concat(F.lit("\n\n"), body)).otherwise(""), F.lit("\n"))
    order = Window.partitionBy("repo").orderBy(F.desc("item.merged_at"), F.desc("number"))
    return rows.select(
        "repo", (F.row_number().over(order) - 1).cast("long").alias("pos"), pull_sha(F.col("item")).alias("sha"), F.array("item.base.sha").alias("parents"),
        normalize_date(F.col("item.merged_at")).alias("date"), message.alias("message"), F.coalesce("files", F.array().cast(T.ArrayType(FILE))).alias("files"), request.alias("pull_request"),
    ).select(*COMMIT.fieldNames())


def replayed(spark: SparkSession, folder: str, since: str | None = None, seen: DataFrame | None = None, limit: int | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """The commits of all recorded requests of a folder. Without a recorded listing, requests whose details are there are not known."""
    responses = read_responses(spark, folder)
    return pull_commits(merged(listing(responses), since, seen, limit), commits(responses), files(responses), max_files)


# --- the network -------------------------------------------------------------------------------


class RequestError(RuntimeError):
    """A request failed for good."""


@dataclass
class Stats:
    """Counters of one client."""

    sent: int = 0
    cached: int = 0
    retried: int = 0
    waited: float = 0.0
    remaining: int | None = None

    def describe(self) -> str:
        text = f"{self.sent} requests, {self.cached} unchanged, {self.retried} retried, waited {self.waited:.0f} s"
        return text + (f", {self.remaining} left" if self.remaining is not None else "")


@dataclass
class Clock:
    """Time, replaceable in tests."""

    now: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep


@dataclass
class Reply:
    status: int
    headers: dict[str, str]
    body: bytes


def network(url: str, headers: dict[str, str], timeout: float) -> Reply:
    """One request with the standard library, which honours the environment's proxies."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as reply:
            return Reply(reply.status, {k.lower(): v for k, v in reply.headers.items()}, reply.read())
    except urllib.error.HTTPError as error:
        return Reply(error.code, {k.lower(): v for k, v in error.headers.items()}, error.read())


def key_of(url: str) -> str:
    """A request's name: method, path and sorted query."""
    parts = urllib.parse.urlsplit(url)
    query = urllib.parse.urlencode(sorted(urllib.parse.parse_qsl(parts.query)))
    return f"GET {parts.path}" + (f"?{query}" if query else "")


@dataclass
class Cache:
    """Replies by address, one file each, replaced atomically. A cache that cannot be written only warns."""

    folder: str
    failure: str | None = None

    def _path(self, url: str) -> str:
        return os.path.join(self.folder, hashlib.sha256(url.encode()).hexdigest() + ".json")

    def get(self, url: str) -> dict | None:
        try:
            with open(self._path(url), encoding="utf-8") as file:
                held = json.load(file)
            return held if held.get("url") == url else None
        except (OSError, ValueError):
            return None

    def put(self, url: str, record: dict) -> None:
        path = self._path(url)
        try:
            os.makedirs(self.folder, exist_ok=True)
            with open(f"{path}.{os.getpid()}", "w", encoding="utf-8") as file:
                json.dump(record | {"url": url}, file)
            os.replace(f"{path}.{os.getpid()}", path)
        except OSError as error:
            self.failure = str(error)


@dataclass
class Client:
    """GET with paging, conditional requests, rate limits and retries."""

    token: str | None = None
    api: str = API
    cache: Cache | None = None
    send: Callable[[str, dict[str, str], float], Reply] = network
    clock: Clock = field(default_factory=Clock)
    retries: int = 4
    max_wait: float = 900.0
    timeout: float = 30.0
    stats: Stats = field(default_factory=Stats)
    #: When the request budget is filled again, if the last good reply used it up.
    filled: float | None = None

    def _pause(self, seconds: float, why: str) -> None:
        if seconds > self.max_wait:
            raise RequestError(f"{why}: {seconds:.0f} s to wait, {self.max_wait:.0f} s allowed")
        self.stats.waited += seconds
        self.clock.sleep(seconds)

    def _delay(self, reply: Reply, attempt: int) -> float | None:
        """Seconds to wait before another attempt, or None if there is no use in one."""
        if reply.status in (403, 429):
            if "retry-after" in reply.headers:
                return self._after(reply.headers["retry-after"])
            if reply.headers.get("x-ratelimit-remaining") == "0":
                return max(0.0, self._reset(reply) - self.clock.now()) + 1
            return 60.0 * 2**attempt if reply.status == 429 or b"secondary rate limit" in reply.body.lower() else None
        return float(2**attempt) if reply.status >= 500 else None

    def _reset(self, reply: Reply) -> float:
        """When the budget is filled again; a header that is no number means a minute from now."""
        try:
            return float(reply.headers.get("x-ratelimit-reset", "0"))
        except ValueError:
            return self.clock.now() + 60

    def _after(self, told: str) -> float:
        """Seconds that a Retry-After header asks for: a number, or a date; anything else is a minute."""
        try:
            return max(0.0, float(told))
        except ValueError:
            try:
                return max(0.0, parsedate_to_datetime(told).timestamp() - self.clock.now())
            except ValueError:
                return 60.0

    def get(self, url: str) -> tuple[object, str | None]:
        """The decoded body and the address of the next page."""
        held = self.cache.get(url) if self.cache else None
        headers = {"Accept": "application/vnd.github+json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        for name, key in (("If-None-Match", "etag"), ("If-Modified-Since", "modified")):
            if held and held.get(key):
                headers[name] = held[key]
        if self.filled is not None:
            filled, self.filled = self.filled, None
            self._pause(max(0.0, filled - self.clock.now()) + 1, "the request budget is used up")
        for attempt in range(self.retries + 1):
            try:
                reply = self.send(url, headers, self.timeout)
            except OSError as error:
                reply = Reply(599, {}, str(error).encode())
            self.stats.sent += 1
            if (left := reply.headers.get("x-ratelimit-remaining", "")).isdigit():
                self.stats.remaining = int(left)
                if left == "0" and reply.status in (200, 304):
                    self.filled = self._reset(reply)
            if reply.status == 304 and held:
                self.stats.cached += 1
                return held["json"], held["next"]
            if reply.status == 200:
                following = next((m[1] for part in reply.headers.get("link", "").split(",") if (m := re.match(r'\s*<([^>]*)>.*rel="?next"?', part))), None)
                data = json.loads(reply.body)
                if self.cache and (reply.headers.get("etag") or reply.headers.get("last-modified")):
                    self.cache.put(url, {"json": data, "next": following, "etag": reply.headers.get("etag"), "modified": reply.headers.get("last-modified")})
                return data, following
            delay = self._delay(reply, attempt)
            if delay is None or attempt == self.retries:
                break
            self.stats.retried += 1
            self._pause(delay, key_of(url))
        raise RequestError(f"{key_of(url)}: {reply.status} {reply.body[:200].decode('utf-8', 'replace')}")

    def items(self, path: str, **query: object) -> Iterator[dict]:
        """The items of a paged list, page by page as they are asked for."""
        url = f"{self.api.rstrip('/')}{path}?{urllib.parse.urlencode({'per_page': 100, **query})}"
        while url:
            data, url = self.get(url)
            if not isinstance(data, list):
                raise RequestError(f"{path}: a list was expected")
            yield from data


def _trim(value: object, kind: T.DataType) -> object:
    """Only the fields of a schema: what is recorded is what is read."""
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return {f.name: _trim(value[f.name], f.dataType) for f in kind if f.name in value}
    return [_trim(v, kind.elementType) for v in value] if isinstance(kind, T.ArrayType) and isinstance(value, list) else value


def record(client: Client, repo: str, folder: str, limit: int, since: str | None = None, seen: frozenset[str] = frozenset(), max_files: int = MAX_FILES) -> int:
    """Fetch merged requests and write their responses as ``read_responses`` reads them.

    The listing stops at the watermark or when enough are found; files come before commits, and a
    request with too many files is not read further.
    """
    if not REPO_NAME.match(repo):
        raise ValueError(f"{repo!r} is no OWNER/REPO")
    os.makedirs(folder, exist_ok=True)

    def save(path: str, items: list, kind: T.StructType) -> None:
        key = f"GET {path}?page=1&per_page=100"
        body = {"format": "http-fixture", "version": FIXTURE_VERSION, "key": key, "responses": [{"status": 200, "headers": {}, "json": [_trim(i, kind) for i in items], "text": None}]}
        with open(os.path.join(folder, hashlib.sha256(key.encode()).hexdigest()[:16] + ".json"), "w", encoding="utf-8") as out:
            json.dump(body, out, sort_keys=True)

    root, listed, found = f"/repos/{repo}/pulls", [], []
    for item in client.items(root, state="closed", sort="updated", direction="desc"):
        if since is not None and item["updated_at"] <= since:
            break
        listed.append(item)
        sha = item.get("merge_commit_sha") or item["head"]["sha"]
        if item.get("merged_at") and sha not in seen and item["number"] not in found:
            found.append(item["number"])
        if len(found) >= limit:
            break
    save(root, listed, PULL_ITEM)
    for number in found:
        kept = []
        for item in client.items(f"{root}/{number}/files"):
            kept.append(item)
            if len(kept) > max_files:
                break
        save(f"{root}/{number}/files", kept, FILE_ITEM)
        if len(kept) <= max_files:
            save(f"{root}/{number}/commits", list(client.items(f"{root}/{number}/commits")), COMMIT_ITEM)
    return len(found)
