"""Ledgers of older and newer versions."""

import json
import os

import pytest

from gritsieve.operators.dedupe import fingerprint_of
from gritsieve.streaming import ledger as ld
from gritsieve.streaming.ledger import Ledger, LedgerError
from pyspark.sql import functions as F


@pytest.fixture
def old(spark, tmp_path):
    """A ledger of version 1 with two entries, of two hunks and of none."""
    path = str(tmp_path / "l")
    os.makedirs(f"{path}/commits")
    patch = spark.range(1).select(fingerprint_of(F.array(F.lit("a" * 16), F.lit("b" * 16)))["patch"]).first()[0]
    rows = [(1, patch, "o/r", "s1", "one", "proposed", None, "2024-01-01"), (2, "f" * 16, "o/r", "s2", "two", "claimed", "me", "2024-01-02")]
    spark.createDataFrame(rows, ld.OLDER[1]["entries"]).write.parquet(f"{path}/entries/a")
    spark.createDataFrame([(1, "a" * 16), (1, "b" * 16)], ld.HUNKS).write.parquet(f"{path}/hunks/a")
    with open(f"{path}/commits/000000000003.json", "w") as out:
        json.dump({"version": 1, "folders": {"entries": ["entries/a"], "hunks": ["hunks/a"]}}, out)
    return path


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def test_an_old_ledger_is_read_without_a_write(spark, old):
    before = files(old)
    ledger = Ledger(spark, old, create=False)
    assert [(r["id"], r["hunk_count"]) for r in ledger.entries().collect()] == [(1, 2), (2, 0)]
    assert ledger.watermarks().count() == 0 and ledger.seen("o/r", "clone").count() == 0
    proposal = spark.createDataFrame([(0, "x/y", "s9", "copy", ["b" * 16, "a" * 16])], "ord long, repo string, sha string, subject string, h array<string>")
    verdict = ledger.check(proposal.select("ord", "repo", "sha", "subject", fingerprint_of(F.col("h")).alias("fingerprint"))).first()
    assert verdict["status"] == "duplicate" and verdict["matches"][0]["id"] == 1
    assert ledger.entry("o/r", "s2")["owner"] == "me" and ledger.entry("o/r", "s3") is None
    assert files(old) == before


def test_the_next_writer_migrates(spark, old):
    ledger = Ledger(spark, old)
    entry, _ = ledger.add({"repo": "o/r", "sha": "s3", "subject": "three", "hunks": ["c" * 16]})
    assert entry["id"] == 3
    held = json.load(open(f"{old}/commits/000000000004.json"))
    assert held["version"] == 2 and held["fingerprints"] == 2 and all("://" not in f and not f.startswith("file:") for fs in held["folders"].values() for f in fs)
    again = Ledger(spark, old, create=False)
    assert [(r["id"], r["hunk_count"]) for r in again.entries().collect()] == [(1, 2), (2, 0), (3, 1)]
    assert json.load(open(f"{old}/commits/000000000003.json"))["version"] == 1  # the old commit stays as it was


def test_a_dry_run_leaves_an_old_ledger_old(spark, old):
    ledger = Ledger(spark, old)
    ledger.begin()
    walked = spark.createDataFrame([("o/r", "clone", "s1")], "repo string, source string, sha string")
    marks = spark.createDataFrame([("o/r", "clone", "p")], "repo string, source string, position string")
    ledger.record(spark.createDataFrame([], "ord long, repo string, sha string, subject string, fingerprint struct<patch:string,hunks:array<string>>"), walked, marks)
    assert ledger.watermark("o/r", "clone")["position"] == "p"
    ledger.rollback()
    assert os.listdir(f"{old}/commits") == ["000000000003.json"] or [n for n in os.listdir(f"{old}/commits") if n.endswith(".json")] == ["000000000003.json"]
    assert Ledger(spark, old, create=False).watermark("o/r", "clone") is None


@pytest.mark.parametrize("commit, reason", [({"version": 3}, "newer"), ({"version": "2"}, "not known"), ({"version": 2, "fingerprints": 1}, "never match"), ({"version": 0}, "not known")])
def test_other_versions_are_refused(spark, tmp_path, commit, reason):
    os.makedirs(tmp_path / "l" / "commits")
    (tmp_path / "l" / "commits" / "000000000001.json").write_text(json.dumps(commit | {"folders": {}}))
    with pytest.raises(LedgerError, match=reason):
        Ledger(spark, str(tmp_path / "l"), create=False).entries()
