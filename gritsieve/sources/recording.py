"""Recorded histories: JSON lines, gzip if the name says so; a header line, then one commit a line.

Reading is a text scan and ``from_json`` with a fixed schema: lines are parsed and checked where they
are read, by splits; a gzip file is one split. Absent patch fields take their
defaults; absent hunk hashes stay unknown. Bad lines are errors that name the file and the reason.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gritsieve.functions.text import strip_credentials
from gritsieve.schema import COMMIT, FILE, PATCH, RECORDING_VERSION
from gritsieve.scratch import Scratch
from gritsieve.sources.ordered import Sorted, formatted, numbered_lines, write_pieces

#: The format's name in the header; recordings of other tools carry a prefix of their own.
FORMAT = "gritsieve-history"
ANY_FORMAT = r"\A[a-z]+-history\z"

_PATCH_KEYS = PATCH.fieldNames()
#: Patches are read as maps of JSON first, so that keys nobody knows are seen.
_RAW_FILE = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("added", T.IntegerType()), T.StructField("deleted", T.IntegerType()),
    T.StructField("old_path", T.StringType()), T.StructField("signals", T.ArrayType(T.StringType())), T.StructField("patch", T.MapType(T.StringType(), T.StringType())),
])
_RAW = T.StructType([
    T.StructField("format", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("repo", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("head", T.StringType()), T.StructField("commits", T.LongType()),
    T.StructField("sha", T.StringType()), T.StructField("parents", T.ArrayType(T.StringType())), T.StructField("date", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("files", T.ArrayType(_RAW_FILE)), T.StructField("_corrupt_record", T.StringType()),
])

HEADER = "path string, repo string, url string, head string, commits long"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = numbered_lines(spark, path)
    return rows.where(F.trim("line") != "").select("path", "pos", F.from_json("line", _RAW, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "line")


def _fail(bad: Column, reason: str) -> Column:
    """Raises with the file and line where ``bad`` holds, else true."""
    return F.when(bad, F.raise_error(F.concat("path", F.lit(", line "), (F.col("pos") + 1).cast("string"), F.lit(f": {reason}"))).cast("boolean")).otherwise(True)


def _count(patch: Column, key: str, default: Column) -> Column:
    return F.coalesce(F.try_element_at(patch, F.lit(key)).cast("int"), default).alias(key)


def _strings(patch: Column, key: str) -> Column:
    return F.from_json(F.try_element_at(patch, F.lit(key)), T.ArrayType(T.StringType()))


def _file(raw: Column) -> Column:
    p = raw["patch"]
    hunks = F.try_element_at(p, F.lit("hunks")).cast("int")
    none = F.array().cast("array<string>")
    patch = F.struct(
        hunks.alias("hunks"), _count(p, "code_hunks", hunks), _count(p, "code_added", raw["added"]), _count(p, "code_deleted", raw["deleted"]),
        _count(p, "test_added", F.lit(0)), _count(p, "test_deleted", F.lit(0)), _count(p, "asserts", F.lit(0)),
        F.coalesce(_strings(p, "api"), none).alias("api"), _strings(p, "hunk_hashes").alias("hunk_hashes"), F.coalesce(_strings(p, "tests"), none).alias("tests"),
    )
    return F.struct(raw["path"].alias("path"), raw["added"].alias("added"), raw["deleted"].alias("deleted"), raw["old_path"].alias("old_path"), F.coalesce(raw["signals"], none).alias("signals"), F.when(p.isNotNull(), patch).alias("patch")).cast(FILE)


def _bad_file(raw: Column) -> Column:
    p = raw["patch"]
    unknown = F.exists(F.map_keys(p), lambda k: ~k.isin(*_PATCH_KEYS))
    negative = (F.coalesce(raw["added"], F.lit(0)) < 0) | (F.coalesce(raw["deleted"], F.lit(0)) < 0)
    patched = p.isNotNull() & (raw["added"].isNull() | raw["deleted"].isNull() | unknown | F.try_element_at(p, F.lit("hunks")).cast("int").isNull())
    return raw["path"].isNull() | negative | patched


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each recording: where it came from and how many commits it says it has."""
    head = _lines(spark, path).where("pos = 0")
    good = _fail(~F.coalesce(F.col("r.format").rlike(ANY_FORMAT), F.lit(False)), "not a recorded history") & _fail(F.coalesce(F.col("r.version") != RECORDING_VERSION, F.lit(True)), "unsupported version")
    good = good & _fail(F.col("r.repo").isNull() | F.col("r.commits").isNull(), "the header lacks its repository or its count")
    return head.where(good).select("path", "r.repo", "r.url", "r.head", "r.commits")


def read_recording(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """The commits of one or more recordings, with ``repo`` and ``pos`` (0 is the newest).

    ``check`` compares the number of commits with the header, which reads the files once more.
    """
    rows = _lines(spark, path).where("pos > 0")
    good = _fail(F.col("r._corrupt_record").isNotNull(), "invalid JSON")
    for name in ("sha", "parents", "date", "message", "files"):
        good = good & _fail(F.col(f"r.{name}").isNull(), f"no {name}, or of the wrong type")
    good = good & _fail(F.exists("r.files", _bad_file), "a file entry is malformed")
    headers = read_headers(spark, path)
    if check:
        counted = headers.join(rows.groupBy("path").agg(F.count("*").alias("n")), "path", "left").where(F.col("commits") != F.coalesce("n", F.lit(0))).select("path", "commits", F.coalesce("n", F.lit(0)).alias("n")).first()
        if counted:
            raise ValueError(f"{counted['path']}: the header says {counted['commits']} commits, the file has {counted['n']}")
    parsed = rows.where(good).select("path", (F.col("pos") - 1).alias("pos"), "r.sha", "r.parents", "r.date", "r.message", F.transform("r.files", _file).alias("files"))
    out = parsed.join(headers.select("path", "repo"), "path").withColumn("pull_request", F.lit(None).cast(COMMIT["pull_request"].dataType))
    return out.select(*COMMIT.fieldNames())


def commit_record(commit: dict) -> dict:
    """One commit as it is stored: fields that hold their default are left out."""

    def file(f: dict) -> dict:
        out = {"path": f["path"], "added": f["added"], "deleted": f["deleted"]}
        if f.get("old_path") is not None:
            out["old_path"] = f["old_path"]
        if f.get("signals"):
            out["signals"] = list(f["signals"])
        if (p := f.get("patch")) is not None:
            usual = {"code_hunks": p["hunks"], "code_added": f["added"], "code_deleted": f["deleted"], "test_added": 0, "test_deleted": 0, "asserts": 0, "api": [], "tests": []}
            out["patch"] = {"hunks": p["hunks"]} | {k: p[k] for k, v in usual.items() if p[k] != v} | ({} if p["hunk_hashes"] is None else {"hunk_hashes": p["hunk_hashes"]})
        return out

    return {k: commit[k] for k in ("sha", "parents", "date", "message")} | {"files": [file(f) for f in commit["files"]]}


def _json(record: dict) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"))


def write_recording(commits: DataFrame, path: str, repo: str, url: str | None = None, head: str | None = None, tasks: int | None = None) -> int:
    """Write one repository's commits in walk order; the same bytes for the same commits.

    Lines are made and sorted by the cluster and joined in blocks; the commits are counted first, for the header.
    """
    spark = commits.sparkSession
    clean = spark.range(1).select(strip_credentials(F.lit(url).cast("string"))).first()[0]
    lines = Scratch(spark, "recording").stash(formatted(commits.select("pos", "sha", "parents", "date", "message", "files"), ("pos",), lambda row: _json(commit_record(row))), "lines")
    total = lines.count()
    header = {"format": FORMAT, "version": RECORDING_VERSION, "repo": repo, "url": clean, "head": head, "commits": total}
    write_pieces(spark, path, [_json(header) + "\n", Sorted(lines, ("pos",), tasks=tasks), *(["\n"] if total else [])])
    return total
