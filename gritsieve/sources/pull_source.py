"""Live pull requests as a data source and as jobs of the cluster.

``spark.read.format("pull_requests")`` lists merged and unmerged requests of repositories, one partition for
each. As a stream its offsets are the newest update of each repository: a batch lists what was updated since
the last one, on the executors. Details (files and commits of a request) are fetched by tasks over a
DataFrame of the chosen numbers and written to the shared folder in rounds, so nothing passes through the
driver or a machine's own folder, and a run that was cut off asks for no request again that it has written.

Options of the source: ``repos`` (names, separated by commas), ``api``, ``token``, ``since`` (stop at this update),
``limit`` (stop after so many merged requests), ``max_wait``, ``cache`` (a folder for conditional requests). Rows are (path, page, json), as those of recorded responses.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gritsieve.scratch import Scratch
from gritsieve.sources import pulls

RESPONSES = "path string, page int, json string"
#: Requests whose responses are written together.
ROUND = 200


def client_of(options: dict) -> pulls.Client:
    cache = pulls.Cache(options["cache"]) if options.get("cache") else None
    return pulls.Client(options.get("token") or None, options.get("api") or pulls.API, cache, max_wait=float(options.get("max_wait") or 900.0))


def listed(client: pulls.Client, repo: str, since: str | None = None, limit: int | None = None, until: str | None = None) -> Iterator[dict]:
    """The requests of a repository, newest update first, down to ``since`` or until ``limit`` merged ones are there."""
    merged: set[int] = set()
    for item in client.items(f"/repos/{repo}/pulls", state="closed", sort="updated", direction="desc"):
        if since is not None and item["updated_at"] <= since:
            return
        if until is not None and item["updated_at"] > until:
            continue
        yield item
        if item.get("merged_at"):
            merged.add(item["number"])
        if limit is not None and len(merged) >= limit:
            return


def _page(repo: str, page: int, items: list[dict]) -> tuple[str, int, str]:
    return f"/repos/{repo}/pulls", page, json.dumps([pulls._trim(i, pulls.PULL_ITEM) for i in items])


def _pages(repo: str, items: Iterator[dict], size: int = 100) -> Iterator[tuple[str, int, str]]:
    held, page = [], 1
    for item in items:
        held.append(item)
        if len(held) == size:
            yield _page(repo, page, held)
            held, page = [], page + 1
    if held:
        yield _page(repo, page, held)


class _Repo(InputPartition):
    def __init__(self, repo: str, since: str | None, until: str | None = None) -> None:
        self.repo, self.since, self.until = repo, since, until


def _repos(options: dict) -> list[str]:
    repos = [r.strip() for r in (options.get("repos") or options.get("path") or "").split(",") if r.strip()]
    for repo in repos:
        if not pulls.REPO_NAME.match(repo):
            raise ValueError(f"{repo!r} is no OWNER/REPO")
    if not repos:
        raise ValueError("no repository is given")
    return repos


class ListingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.repos = options, _repos(options)

    def partitions(self) -> list[_Repo]:
        return [_Repo(r, self.options.get("since") or None) for r in self.repos]

    def read(self, partition: _Repo) -> Iterator[tuple]:
        limit = self.options.get("limit")
        yield from _pages(partition.repo, listed(client_of(self.options), partition.repo, partition.since, int(limit) if limit else None))


class ListingStream(DataSourceStreamReader):
    """Offsets: the newest update of each repository. A request that is updated again comes again, with its new state."""

    def __init__(self, options: dict) -> None:
        self.options, self.repos = options, _repos(options)

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.repos, self.options.get("since") or "")

    def latestOffset(self) -> dict:
        client, found = client_of(self.options), {}
        for repo in self.repos:
            newest, _ = client.get(f"{client.api.rstrip('/')}/repos/{repo}/pulls?per_page=1&state=closed&sort=updated&direction=desc")
            found[repo] = newest[0]["updated_at"] if newest else self.options.get("since") or ""
        return found

    def partitions(self, start: dict, end: dict) -> list[_Repo]:
        return [_Repo(r, start.get(r) or None, end[r]) for r in self.repos if end.get(r, "") > start.get(r, "")]

    def read(self, partition: _Repo) -> Iterator[tuple]:
        yield from _pages(partition.repo, listed(client_of(self.options), partition.repo, partition.since, until=partition.until))

    def commit(self, end: dict) -> None:
        pass


class PullListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pull_requests"

    def schema(self) -> str:
        return RESPONSES

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PullListing)


def details(client: pulls.Client, repo: str, number: int, max_files: int) -> Iterator[tuple[str, int, str]]:
    """The responses about one request; one with too many files is not read further."""
    path, files = f"/repos/{repo}/pulls/{number}", []
    for item in client.items(f"{path}/files"):
        files.append(pulls._trim(item, pulls.FILE_ITEM))
        if len(files) > max_files:
            break
    yield f"{path}/files", 1, json.dumps(files)
    if len(files) <= max_files:
        yield f"{path}/commits", 1, json.dumps([pulls._trim(i, pulls.COMMIT_ITEM) for i in client.items(f"{path}/commits")])


def fetch_details(chosen: DataFrame, options: dict, folder: str, max_files: int = pulls.MAX_FILES, tasks: int = 4, size: int = ROUND) -> DataFrame:
    """Fetch what the shared ``folder`` lacks of the ``chosen`` (repo, number) requests; returns all its responses.

    Each round deals up to ``size`` requests to ``tasks`` tasks, one client each, and appends their responses in one
    commit. Requests whose responses are there are left out, so a job that starts over goes on where it was.
    """
    spark = chosen.sparkSession
    wanted = Scratch(spark, "pull-numbers").stash(chosen.select("repo", "number").distinct(), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = client_of(options)
        for batch in batches:
            for repo, number in zip(batch.column("repo").to_pylist(), batch.column("number").to_pylist()):
                rows = list(zip(*details(client, repo, number, max_files)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int32(), pa.string()))], ["path", "page", "json"])

    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    while True:
        left = wanted
        if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            held = spark.read.schema(RESPONSES).parquet(folder).select(F.regexp_extract("path", r"\A/repos/([^/]+/[^/]+)/pulls/(\d+)/files\z", 1).alias("repo"), F.regexp_extract("path", r"/pulls/(\d+)/files\z", 1).alias("n"))
            left = wanted.join(held.where("n <> ''").select("repo", F.col("n").cast("long").alias("number")), ["repo", "number"], "left_anti")
        turn = left.orderBy("repo", F.desc("number")).limit(size)
        if turn.isEmpty():
            return spark.read.schema(RESPONSES).parquet(folder) if left is not wanted else spark.createDataFrame([], RESPONSES)
        turn.repartition(tasks, "repo", "number").mapInArrow(run, RESPONSES).write.mode("append").parquet(folder)


def pull_requests(
    spark: SparkSession, repo: str, options: dict, since: str | None = None, seen: DataFrame | None = None, limit: int | None = None, max_files: int = pulls.MAX_FILES, folder: str | None = None, tasks: int = 4
) -> tuple[DataFrame, DataFrame]:
    """(commits, listing) of a repository over the network; ``seen`` (sha) is joined on the cluster.

    With ``seen`` rows the listing goes down to ``since``, else it stops at ``limit`` merged requests.
    """
    register(spark)
    scratch = Scratch(spark, "pull-requests")
    given = {"repos": repo, **options, **({"since": since} if since else {}), **({"limit": str(limit)} if limit and seen is None else {})}
    pages = scratch.stash(spark.read.format("pull_requests").options(**{k: v for k, v in given.items() if v is not None}).load(), "listing")
    items = pulls.listing(pages)
    chosen = scratch.stash(pulls.merged(items, since, seen, limit), "chosen")
    responses = fetch_details(chosen.select("repo", F.col("item.number").alias("number")), options, folder or scratch.path("responses"), max_files, tasks)
    return pulls.pull_commits(chosen, pulls.commits(responses), pulls.files(responses), max_files), items
