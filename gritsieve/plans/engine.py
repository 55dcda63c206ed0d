"""The engine: commits to ranked candidates, checked against a ledger, for one source or a batch."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gritsieve.functions.text import strip_credentials, subject
from gritsieve.operators import dedupe, scoring, summaries
from gritsieve.operators.rules import RULES, classify
from gritsieve.operators.stats import diff_stats, explode_files
from gritsieve.scratch import Scratch
from gritsieve.settings import Settings
from gritsieve.sources import git_log, pull_source, pulls, recording
from gritsieve.sources.config import BatchConfig, RepoSpec
from gritsieve.streaming.ledger import Ledger
from gritsieve.streaming.resume import Resume, mode, unseen

KEYS = ("repo", "sha")


class SourceError(RuntimeError):
    """One repository cannot be walked; others go on."""


def evaluate(commits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All commits with their measures, reason, features, scores and ``subject``."""
    files = classify(explode_files(commits, KEYS), settings.rules or RULES)
    return scoring.evaluate(commits, diff_stats(files, KEYS), settings, KEYS).withColumn("subject", subject(F.col("message")))


def mine(commits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``evaluate`` with the candidates' ``rank`` in their repository (null for rejected commits)."""
    found = evaluate(commits, settings)
    # ranks come by a narrow table of the candidates, so no wide row passes the window
    ranks = scoring.ranked(found.select(*KEYS, "score", "ts", "reason")).select(*KEYS, "rank")
    return found.join(ranks, list(KEYS), "left")


def proposals(outcomes: DataFrame, order: Column | None = None) -> DataFrame:
    """Candidates as proposals, judged in the order of ``order`` (a long), else of their rank."""
    ord_ = (F.col("rank") - 1).cast("long") if order is None else order
    return outcomes.where("reason is null").select(ord_.alias("ord"), "repo", "sha", "subject", "fingerprint")


@dataclass
class Run:
    """One source's run: outcomes, verdicts by ``ord``, and what describes them."""

    repo: str
    source: str
    unit: str
    settings: Settings
    outcomes: DataFrame | None = None
    verdicts: DataFrame | None = None
    url: str | None = None
    ledger: str | None = None
    min_overlap: float | None = None
    new_only: bool = False
    resume: Resume | None = None
    notes: tuple[str, ...] = ()
    error: str | None = None

    def judged(self) -> DataFrame:
        """Candidates with status, matches and outcome; without a ledger these are null."""
        rows = self.outcomes.where("reason is null")
        if self.verdicts is None:
            return rows.withColumns({"status": F.lit(None).cast("string"), "matches": F.lit(None).cast("string"), "outcome": F.lit(None).cast("string")})
        joined = rows.withColumn("ord", (F.col("rank") - 1).cast("long")).join(self.verdicts.select("ord", "status", "matches"), "ord", "left")
        return joined.withColumn("outcome", match_outcome(F.col("status"), F.col("matches"), F.col("repo"), F.col("sha")))


def match_outcome(status: Column, matches: Column, repo: Column, sha: Column) -> Column:
    """A batch's view of a verdict whose matches carry repo and sha themselves."""
    best = F.get(matches, F.lit(0))
    own = (best["repo"] == repo) & (best["sha"] == sha)
    return F.when(status.isin("new", "unknown"), status).when(own, "recorded").when(F.exists(matches, lambda m: m["repo"] != repo), "collision").otherwise("internal")


def collisions(judged: DataFrame) -> DataFrame:
    """(repo, sha, subject, rank, status, same_commit, match): candidates that another repository holds."""
    other = F.get(F.filter("matches", lambda m: m["repo"] != F.col("repo")), F.lit(0))
    rows = judged.where("outcome = 'collision'").withColumn("match", other)
    return rows.select("repo", "sha", "subject", "rank", F.when(F.col("match.exact"), "duplicate").otherwise("overlap").alias("status"), (F.col("match.sha") == F.col("sha")).alias("same_commit"), "match", F.col("match.repo").alias("other"))


def best_new(judged: DataFrame, top: int) -> DataFrame:
    """The best new candidates of all repositories: a top-k, not a sort."""
    return judged.where("status = 'new'").orderBy(*scoring.rank_order()).limit(top)


@dataclass
class BatchResult:
    config: BatchConfig
    runs: list[Run]
    full: bool = False
    dry_run: bool = False

    @property
    def done(self) -> list[Run]:
        return [r for r in self.runs if r.error is None]

    @property
    def failed(self) -> list[Run]:
        return [r for r in self.runs if r.error is not None]

    def judged(self) -> DataFrame | None:
        """All candidates of all runs, with ``run_ord``."""
        frames = [r.judged().withColumn("run_ord", F.lit(k)) for k, r in enumerate(self.done)]
        union = frames[0] if frames else None
        for frame in frames[1:]:
            union = union.unionByName(frame, allowMissingColumns=True)
        return union


@dataclass
class Engine:
    """The operations of the command line on a session."""

    spark: SparkSession
    make_client: Callable[[RepoSpec], pulls.Client] | None = None
    progress: Callable[[Run], None] = field(default=lambda run: None)

    # --- single sources ------------------------------------------------------------------------

    def clone(self, path: str, rev: str = "HEAD", limit: int | None = None, content: bool = True, repo: str | None = None) -> DataFrame:
        git_log.register(self.spark)
        # a clone is walked once: what follows reads its rows from the shared folder
        reader = self.spark.read.format("git_history").option("paths", path).option("rev", rev).option("content", str(content).lower())
        return Scratch(self.spark, "clone").stash(reader.options(**{k: str(v) for k, v in (("limit", limit), ("repo", repo)) if v}).load(), "commits")

    def history(self, path: str, limit: int | None = None) -> DataFrame:
        rows = recording.read_recording(self.spark, path)
        return rows.where(F.col("pos") < limit) if limit else rows

    def pull_requests(self, folder: str, since: str | None = None, seen: DataFrame | None = None, limit: int | None = None, max_files: int = pulls.MAX_FILES) -> DataFrame:
        return pulls.replayed(self.spark, folder, since, seen, limit, max_files)

    def run(self, commits: DataFrame, repo: str, source: str, settings: Settings = Settings(), unit: str = "commits", url: str | None = None, ledger: Ledger | None = None, least: float | None = dedupe.MIN_OVERLAP, new_only: bool = False) -> Run:
        """Mine one source and check it against a ledger, which is not written."""
        scratch = Scratch(self.spark, "mine")
        outcomes = scratch.stash(mine(commits.withColumn("repo", F.lit(repo)), settings), "outcomes")
        verdicts = ledger.check(proposals(outcomes), least) if ledger else None
        clean = self.spark.range(1).select(strip_credentials(F.lit(url).cast("string"))).first()[0]
        return Run(repo, source, unit, settings, outcomes, verdicts, clean, ledger.path if ledger else None, least if ledger else None, new_only)

    def record(self, path: str, out: str, rev: str = "HEAD", limit: int | None = None, repo: str | None = None) -> int:
        """Walk a clone once and write its recording."""
        name = repo or os.path.basename(os.path.normpath(path))
        return recording.write_recording(self.clone(path, rev, limit, True, name), out, name, git_log.origin_url(path), git_log.resolve(path, rev))

    def explain(self, commits: DataFrame, prefix: str, settings: Settings = Settings()) -> dict:
        """The outcome of one commit, named by at least four hex digits, with its classified ``files``."""
        if len(prefix) < 4 or any(c not in "0123456789abcdef" for c in prefix.lower()):
            raise ValueError(f"{prefix!r}: at least 4 hex digits are expected")
        found = commits.where(F.col("sha").startswith(prefix.lower())).limit(2)
        rows = evaluate(found, settings).withColumn("rank", F.lit(None).cast("int")).collect()
        if len(rows) != 1:
            raise ValueError(f"{prefix}: {'no commit' if not rows else 'more than one commit'} begins so")
        files = classify(explode_files(self.spark.createDataFrame([(rows[0]["repo"], rows[0]["sha"], rows[0]["files"])], commits.select(*KEYS, "files").schema), KEYS), settings.rules or RULES)
        return rows[0].asDict(recursive=True) | {"files": [r.asDict(recursive=True) for r in files.orderBy("pos_in_commit").collect()]}

    def explain_revision(self, path: str, rev: str, settings: Settings = Settings(), content: bool = True, repo: str | None = None) -> dict:
        """The outcome of the commit that a revision of a clone names; the scan reads this commit alone."""
        sha = git_log.resolve(path, rev)
        git_log.register(self.spark)
        reader = self.spark.read.format("git_history").options(paths=path, rev=sha, limit="1", content=str(content).lower(), **({"repo": repo} if repo else {}))
        found = Scratch(self.spark, "explain").stash(reader.load().where(F.col("sha") == sha), "commit")
        if found.isEmpty():
            raise ValueError(f"{rev} is a merge commit; merges are not candidates")
        return self.explain(found, sha, settings)

    def classify(self, paths: DataFrame, rules=RULES) -> DataFrame:
        """(path, signals) rows with language, category and rule."""
        return classify(paths, rules)

    # --- batches -------------------------------------------------------------------------------

    def _walk(self, spec: RepoSpec, ledger: Ledger, full: bool) -> tuple[DataFrame, Resume, str | None, tuple[str, ...]]:
        """What is new in one repository since its watermark."""
        mark = ledger.watermark(spec.name, spec.source)
        previous = (mark or {}).get("position") or None
        seen = ledger.seen(spec.name, spec.source) if not full else self.spark.createDataFrame([], "sha string")
        note, url, notes = None, spec.url, ()
        if spec.source == "clone":
            head = git_log.resolve(spec.target, spec.rev)
            rev = head
            if previous and not full and previous != head:
                known = git_log.is_ancestor(spec.target, previous, head)
                rev = f"{previous}..{head}" if known else head
                if not known:
                    note = f"watermark {previous[:10]} {'is not in the clone at' if known is None else 'is not an ancestor of'} {head[:10]}; walked everything"
            rows = self.clone(spec.target, rev, None, spec.content, spec.name)
            if previous == head and not full:
                rows = rows.limit(0)
            position, url = head, url or git_log.origin_url(spec.target)
        elif spec.source == "history":
            header = recording.read_headers(self.spark, spec.target).first()
            rows = recording.read_recording(self.spark, spec.target)
            newest = rows.where("pos = 0").select("sha").first()
            position, url = header["head"] or (newest[0] if newest else None), url or header["url"]
        else:
            after = None if full else previous
            if spec.replay is None:
                if self.make_client is None:
                    raise SourceError("there is no client for pull requests")
                client = self.make_client(spec)
                options = {"token": client.token, "api": client.api, "max_wait": str(client.max_wait)}
                held = None if seen.isEmpty() else seen
                rows, listed = pull_source.pull_requests(self.spark, spec.target, options, after, held, spec.limit, spec.max_files)
            else:
                responses = pulls.read_responses(self.spark, spec.replay)
                listed = pulls.listing(responses).where(F.col("repo") == spec.target)
                rows = pulls.pull_commits(pulls.merged(listed, after, seen, spec.limit), pulls.commits(responses), pulls.files(responses), spec.max_files)
            newest = listed.agg(F.max("item.updated_at")).first()[0]
            position = max([p for p in (previous, newest) if p], default=None)
            url = url or f"https://github.com/{spec.target}"
        scratch = Scratch(self.spark, "walk")
        rows = scratch.stash(rows.withColumn("repo", F.lit(spec.name)), "rows")
        kept = scratch.stash(unseen(rows, seen), "kept")
        n, total = kept.count(), rows.count()
        how = "full" if note else mode(previous, full, n)
        return kept, Resume(how, previous, position, total - n, note), url, notes

    def batch(self, config: BatchConfig, ledger: Ledger, only: tuple[str, ...] = (), full: bool = False, dry_run: bool = False, finish: Callable[[BatchResult], None] | None = None) -> BatchResult:
        """Walk every repository, then record all in order in one commit that follows ``finish``.

        A repository that cannot be walked is reported and left out. If anything fails before the
        commit, or in a dry run, the ledger stays as it was.
        """
        walks: list[tuple[RepoSpec, object]] = []
        for spec in config.select(only):
            try:
                walks.append((spec, self._walk(spec, ledger, full)))
            except (SourceError, git_log.GitError, pulls.RequestError, OSError, ValueError) as error:
                walks.append((spec, str(error)))
            except Exception as error:  # Spark wraps what a reader raises
                walks.append((spec, str(error).split("\n")[0]))
        ledger.begin()
        try:
            result = BatchResult(config, [self._record(spec, walk, config, ledger) for spec, walk in walks], full, dry_run)
            if finish:
                finish(result)
            ledger.rollback() if dry_run else ledger.commit()
        except BaseException:
            ledger.rollback()
            raise
        return result

    def _record(self, spec: RepoSpec, walk: object, config: BatchConfig, ledger: Ledger) -> Run:
        run = Run(spec.name, spec.source, spec.unit, spec.settings, ledger=ledger.path, min_overlap=config.min_overlap)
        if isinstance(walk, str):
            run.error = walk
        else:
            rows, run.resume, run.url, run.notes = walk
            run.outcomes = Scratch(self.spark, "batch").stash(mine(rows, spec.settings), "outcomes")
            walked = rows.select("repo", F.lit(spec.source).alias("source"), "sha")
            marks = self.spark.createDataFrame([(spec.name, spec.source, run.resume.watermark or "")], "repo string, source string, position string")
            run.verdicts = ledger.record(proposals(run.outcomes), walked, marks, config.owner, config.min_overlap)
        self.progress(run)
        return run


def funnel_rows(run: Run) -> list[dict]:
    """The funnel of one run as small rows in order."""
    return [r.asDict() for r in summaries.funnel(run.outcomes, []).orderBy("ord").collect()]
