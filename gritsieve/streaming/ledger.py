"""The ledger of fixes: append-only tables under numbered commits.

A commit is one small file that lists the folders each table is made of. A writer writes its folders
and the file first and then renames the file to the next number, which succeeds for exactly one
writer; anyone else starts over from the new state. So readers see whole commits only, a crash before
the rename leaves the ledger as it was, and a batch that must be written with its export commits last.

Adding rows adds folders and rewrites nothing; claims rewrite the entries, and many small folders are
merged now and then. A dry run reads a commit and never makes one.

A commit says its version. An older one goes through a chain of steps, one for each version: readers run them into
the shared scratch folder and publish nothing, so others can still open the ledger as it is; the next writer runs them
into the ledger, and its commit is of the new version. A newer version, or fingerprints of another one, are refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritsieve.operators.dedupe import ENTRIES, HUNKS, MIN_OVERLAP, fold_in_order, hunk_rows
from gritsieve.schema import FINGERPRINT_VERSION, LEDGER_VERSION
from gritsieve.scratch import Scratch

WATERMARKS = "repo string, source string, position string, walked long, runs int, updated string"
WALKED = "repo string, source string, sha string"
TABLES = {"entries": ENTRIES, "hunks": HUNKS, "watermarks": WATERMARKS, "walked": WALKED}
Tables = dict[str, DataFrame]


def _with_counts(spark: SparkSession, held: Tables) -> Tables:
    """1 to 2: entries say how many hunks they have; runs leave watermarks and evaluated keys."""
    counts = held["hunks"].groupBy(F.col("entry_id").alias("id")).agg(F.count("*").cast("int").alias("hunk_count"))
    entries = held["entries"].join(counts, "id", "left").withColumn("hunk_count", F.coalesce("hunk_count", F.lit(0)))
    return {"entries": entries, "watermarks": spark.createDataFrame([], WATERMARKS), "walked": spark.createDataFrame([], WALKED)}


#: The tables of older versions, and the step that leads to the next one: the tables that it makes anew.
OLDER = {1: {"entries": ENTRIES.removesuffix(", hunk_count int"), "hunks": HUNKS}}
STEPS: dict[int, Callable[[SparkSession, Tables], Tables]] = {1: _with_counts}
#: Folders of a table before they are merged into one.
MANY = 32
MATCH = "array<struct<place:int,id:bigint,repo:string,sha:string,subject:string,status:string,owner:string,first_seen:string,shared:int,smaller:int,exact:boolean,in_run:boolean>>"


class LedgerError(RuntimeError):
    """The ledger cannot be read or written."""


class LedgerConflict(LedgerError):
    """Another writer was faster; nothing of this write was kept."""


def utc_now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


@dataclass(frozen=True)
class State:
    """One commit: its number and the folders of each table."""

    number: int
    folders: dict[str, tuple[str, ...]]


class Ledger:
    def __init__(self, spark: SparkSession, path: str, create: bool = True) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        place = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        self._fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._fs.exists(place):
            if not create:
                raise LedgerError(f"{path}: there is no ledger")
            self._fs.mkdirs(place)
        self._staged: State | None = None
        self._views: dict[int, State] = {}

    # --- commits -------------------------------------------------------------------------------

    def _commit_path(self, number: int):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{number:012d}.json")

    def state(self, owned: bool = False) -> State:
        """The staged state of an open transaction, else the newest commit; ``owned``: for a write that follows it."""
        if self._staged is not None:
            return self._staged
        names = [f.getPath().getName() for f in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits"))]
        numbers = [int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()]
        if not numbers:
            return State(0, {t: () for t in TABLES})
        number = max(numbers)
        stream = self._fs.open(self._commit_path(number))
        try:
            held = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        version = held.get("version")
        if not isinstance(version, int) or not (version == LEDGER_VERSION or version in STEPS):
            raise LedgerError(f"{self.path}: version {version!r} is not known" + (", it is newer than this program" if isinstance(version, int) and version > LEDGER_VERSION else ""))
        if (found := held.get("fingerprints", FINGERPRINT_VERSION)) != FINGERPRINT_VERSION:
            raise LedgerError(f"{self.path}: fingerprints of version {found!r} never match those of version {FINGERPRINT_VERSION}")
        if version < LEDGER_VERSION:
            return self._migrated(number, version, held["folders"], owned)
        return State(number, {t: tuple(held["folders"].get(t, ())) for t in TABLES})

    def _migrated(self, number: int, version: int, folders: dict[str, list[str]], owned: bool) -> State:
        """The state after all steps: as folders of the ledger that no commit lists yet, or as a view outside of it."""
        if not owned and number in self._views:
            return self._views[number]
        scratch, held, now = Scratch(self.spark, "ledger-view"), {t: tuple(f) for t, f in folders.items()}, dict(OLDER[version])
        for step in range(version, LEDGER_VERSION):
            made = STEPS[step](self.spark, {t: self._read(held.get(t, ()), schema) for t, schema in now.items()})
            now = OLDER.get(step + 1, TABLES)
            for table, rows in made.items():
                name = f"{table}/{uuid.uuid4().hex}" if owned else scratch.path(f"{table}-{step}")
                rows.select(*self.spark.createDataFrame([], now[table]).columns).write.parquet(f"{self.path}/{name}" if owned else name)
                held[table] = (name,)
        state = State(number, {t: held.get(t, ()) for t in TABLES})
        if not owned:
            self._views[number] = state
        return state

    def _read(self, folders: tuple[str, ...], schema: str) -> DataFrame:
        paths = [f if "://" in f or f.startswith(("/", "file:")) else f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _publish(self, state: State) -> None:
        """Write the commit under a name of its own, then rename it to its number: it is there whole or not at all.

        A rename must fail where the name is taken, as it does on HDFS and local disks. Stores without
        such a rename need a lock of their own around writers; readers are safe on any.
        """
        path = self._commit_path(state.number)
        part = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/.{uuid.uuid4().hex}.part")
        data = json.dumps({"version": LEDGER_VERSION, "fingerprints": FINGERPRINT_VERSION, "folders": state.folders}, sort_keys=True).encode()
        try:
            out = self._fs.create(part, False)
            out.write(bytearray(data))
            out.close()
            files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            files.rename(self._fs.makeQualified(part), self._fs.makeQualified(path), self._spark_array())
        except Exception as error:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(error):
                raise LedgerConflict(f"{self.path}: commit {state.number} was made by another writer") from None
            raise LedgerError(f"{self.path}: {error}") from None

    def _spark_array(self):
        """No options: a rename that overwrites nothing."""
        return self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def begin(self) -> None:
        """Open a transaction: later changes are visible here at once and kept by ``commit`` only."""
        if self._staged is not None:
            raise LedgerError("a transaction is open")
        held = self.state(owned=True)
        self._staged = State(held.number + 1, held.folders)

    def commit(self) -> None:
        staged, self._staged = self._staged, None
        if staged is None:
            raise LedgerError("no transaction is open")
        self._publish(staged)

    def rollback(self) -> None:
        self._staged = None

    def _change(self, **rows: tuple[DataFrame, bool]) -> None:
        """Write rows as new folders; each is appended, or replaces its table."""
        held = self.state(owned=True)
        folders = dict(held.folders)
        for table, (df, replaces) in rows.items():
            if not replaces and len(folders[table]) >= MANY:
                df, replaces = self.table(table).unionByName(df), True
            name = f"{table}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{name}")
            folders[table] = (name,) if replaces else (*folders[table], name)
        if self._staged is not None:
            self._staged = State(self._staged.number, folders)
        else:
            self._publish(State(held.number + 1, folders))

    # --- tables --------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        return self._read(self.state().folders[name], TABLES[name])

    def entries(self, repo: str | None = None) -> DataFrame:
        """Entries, oldest first."""
        rows = self.table("entries")
        return (rows if repo is None else rows.where(F.col("repo") == repo)).orderBy("first_seen", "id")

    def entry(self, repo: str, sha: str) -> dict | None:
        """The entry of a commit."""
        row = self.table("entries").where((F.col("repo") == repo) & (F.col("sha") == sha)).first()
        return row.asDict() if row else None

    def watermarks(self) -> DataFrame:
        return self.table("watermarks").orderBy("repo", "source")

    def watermark(self, repo: str, source: str) -> dict | None:
        row = self.table("watermarks").where((F.col("repo") == repo) & (F.col("source") == source)).first()
        return row.asDict() if row else None

    def seen(self, repo: str, source: str) -> DataFrame:
        """The shas that runs of a repository and source evaluated."""
        return self.table("walked").where((F.col("repo") == repo) & (F.col("source") == source)).select("sha")

    # --- verdicts ------------------------------------------------------------------------------

    def _named(self, folded: DataFrame, known: DataFrame, base: int) -> DataFrame:
        """(ord, inserted, id, status, matches) with what each match's entry says, in their order."""
        number = lambda c: F.when(c < 0, base - c).otherwise(c)
        rows = folded.select("ord", F.posexplode("matches").alias("place", "m")).select("ord", "place", number(F.col("m.id")).alias("id"), "m.shared", "m.smaller", "m.exact", "m.in_run")
        told = rows.join(known, "id").groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("place", "id", "repo", "sha", "subject", "status", "owner", "first_seen", "shared", "smaller", "exact", "in_run"))).cast(MATCH).alias("matches"))
        return folded.select("ord", "inserted", number(F.col("id")).alias("id"), "status").join(told, "ord", "left").withColumn("matches", F.coalesce("matches", F.array().cast(MATCH)))

    def _fold(self, proposals: DataFrame, least: float | None, owner: str | None, now: str, check: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Verdicts in order, with the entries and hunks that the run adds."""
        scratch = Scratch(self.spark, "ledger")
        entries, hunks = self.table("entries"), self.table("hunks")
        if proposals.isEmpty():  # a run that only walked
            verdicts = self.spark.createDataFrame([], f"ord long, inserted boolean, id long, status string, matches {MATCH}")
            return verdicts, entries.limit(0), hunks.limit(0)
        base = entries.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        folded = scratch.stash(fold_in_order(proposals, entries, hunks, scratch, least, keep_overlaps=check, own_first=not check), "folded")
        new = folded.where("inserted").select("ord").join(proposals, "ord")
        count = F.size(F.array_distinct("fingerprint.hunks"))
        added = new.select((F.lit(base + 1) + F.col("ord")).alias("id"), F.col("fingerprint.patch").alias("fingerprint"), "repo", "sha", "subject", F.lit("proposed").alias("status"), F.lit(owner).cast("string").alias("owner"), F.lit(now).alias("first_seen"), count.alias("hunk_count"))
        more = hunk_rows(new).select((F.lit(base + 1) + F.col("ord")).alias("entry_id"), "hash")
        return scratch.stash(self._named(folded, entries.unionByName(added), base), "verdicts"), added, more

    def check(self, proposals: DataFrame, least: float | None = MIN_OVERLAP) -> DataFrame:
        """Verdicts on proposals against the ledger and the proposals before them; nothing is written."""
        return self._fold(proposals, least, None, utc_now(), True)[0].drop("inserted")

    def record(self, proposals: DataFrame, walked: DataFrame, marks: DataFrame, owner: str | None = None, least: float | None = MIN_OVERLAP, now: str | None = None) -> DataFrame:
        """Record runs in one change: new fixes as proposed, evaluated keys, watermarks.

        ``walked`` is (repo, source, sha); ``marks`` is (repo, source, position), one row a run, runs
        without new rows included. Returns the verdicts.
        """
        now = now or utc_now()
        verdicts, added, hunks = self._fold(proposals, least, owner, now, False)
        keys = walked.select("repo", "source", "sha").distinct()
        counts = keys.groupBy("repo", "source").agg(F.count("*").alias("n"))
        held = self.table("watermarks").select("repo", "source", F.col("position").alias("p"), F.col("walked").alias("w"), F.col("runs").alias("r"), F.col("updated").alias("u"))
        fresh = marks.select("repo", "source", "position").join(counts, ["repo", "source"], "left")
        merged = held.join(fresh, ["repo", "source"], "full")
        new = F.col("position").isNotNull()
        merged = merged.select(
            "repo", "source", F.coalesce("position", "p").alias("position"), (F.coalesce("w", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("walked"),
            (F.coalesce("r", F.lit(0)) + new.cast("int")).alias("runs"), F.when(new, now).otherwise(F.col("u")).alias("updated"),
        )
        unseen = keys.join(self.table("walked"), ["repo", "source", "sha"], "left_anti")
        self._change(entries=(added, False), hunks=(hunks, False), walked=(unseen, False), watermarks=(merged, True))
        return verdicts

    def add(self, proposal: dict, status: str = "claimed", owner: str | None = None, least: float | None = MIN_OVERLAP, now: str | None = None) -> tuple[dict | None, dict]:
        """Add one fix (repo, sha, subject, hunks) unless it is there; claim it if it is only proposed.

        Returns the entry, or None where it was refused, and the verdict. Races are decided by the
        commit: the loser judges again against what the winner wrote.
        """
        if status not in ("proposed", "claimed"):
            raise LedgerError(f"unknown status {status!r}")
        rows = self.spark.createDataFrame([(0, proposal["repo"], proposal["sha"], proposal["subject"], proposal.get("hunks") or [])], "ord long, repo string, sha string, subject string, hunks array<string>")
        from gritsieve.operators.dedupe import fingerprint_of

        rows = rows.select("ord", "repo", "sha", "subject", fingerprint_of(F.col("hunks")).alias("fingerprint"))
        while True:
            try:
                return self._add(rows, status, owner, least, now or utc_now())
            except LedgerConflict:
                if self._staged is not None:
                    raise

    def _add(self, rows: DataFrame, status: str, owner: str | None, least: float | None, now: str) -> tuple[dict | None, dict]:
        mine = self._staged is None
        if mine:
            self.begin()
        try:
            verdicts, added, hunks = self._fold(rows, least, owner, now, True)
            verdict = verdicts.drop("inserted").first().asDict(recursive=True)
            best = verdict["matches"][0] if verdict["matches"] else None
            done = None
            if verdict["status"] == "new" and added.count():
                self._change(entries=(added.withColumn("status", F.lit(status)), False), hunks=(hunks, False))
                done = added.withColumn("status", F.lit(status)).first().asDict()
            elif verdict["status"] == "new":  # the same commit is held under another fingerprint
                row = rows.first()
                held = self.entry(row["repo"], row["sha"])
                verdict |= {"status": "duplicate", "matches": [{"place": 0, **{k: held[k] for k in ("id", "repo", "sha", "subject", "status", "owner", "first_seen")}, "shared": held["hunk_count"], "smaller": held["hunk_count"], "exact": False, "in_run": False}]}
            elif verdict["status"] == "duplicate" and best["status"] == "proposed" and status == "claimed":
                taken = (F.col("id") == best["id"]) & (F.col("status") == "proposed")
                entries = self.table("entries").withColumn("owner", F.when(taken, F.lit(owner)).otherwise(F.col("owner"))).withColumn("status", F.when(taken, "claimed").otherwise(F.col("status")))
                self._change(entries=(entries, True))
                done = self.table("entries").where(F.col("id") == best["id"]).first().asDict()
            if mine:
                self.commit() if done else self.rollback()
            return done, verdict
        except BaseException:
            if mine:
                self.rollback()
            raise
