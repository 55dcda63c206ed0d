"""Ordered files: line numbers at any size of the splits, and the same bytes at any number of tasks."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from gritsieve.sources import recording
from gritsieve.sources.ordered import Sorted, formatted, numbered_lines, write_pieces


@pytest.fixture
def splits(spark):
    """Sets the size of the splits and puts the old one back."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    held = {n: spark.conf.get(n) for n in names}

    def set_(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield set_
    for n, v in held.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [64, 1000, 1 << 27])
def test_line_numbers(spark, splits, tmp_path, size):
    rng, want = random.Random(1), []
    for name in ("a.txt", "b.txt", "c.txt.gz"):
        lines = ["" if rng.random() < 0.1 else "é" * rng.randrange(60) + str(k) for k in range(200)]
        data = "\n".join(lines).encode() + (b"\n" if name == "a.txt" else b"")
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
        want += [(name, k, line) for k, line in enumerate(lines)]
    splits(size)
    rows = numbered_lines(spark, [str(tmp_path / n) for n in ("a.txt", "b.txt", "c.txt.gz")])
    assert size > 999 or rows.rdd.getNumPartitions() > 3
    assert sorted((r["path"].rsplit("/", 1)[1], r["pos"], r["line"]) for r in rows.collect()) == want


def commits(spark, n):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        patch = {"hunks": 1, "code_hunks": k % 2, "code_added": 1, "code_deleted": 0, "test_added": 0, "test_deleted": 0, "asserts": k % 3, "api": [], "hunk_hashes": [f"{k:016x}"], "tests": []}
        files = [{"path": f"src/é{k}.py", "added": rng.randrange(9), "deleted": 1, "old_path": None, "signals": [], "patch": patch if k % 4 else None}]
        rows.append({"repo": "r", "pos": k, "sha": f"{k:040x}", "parents": [f"{k + 1:040x}"], "date": "2024-01-01T00:00:00+00:00", "message": f"m {k}\n\nline two\u2028", "files": files, "pull_request": None})
    return spark.createDataFrame(rows, recording.COMMIT)


@pytest.mark.parametrize("name", ["h.jsonl", "h.jsonl.gz"])
def test_recording_has_the_same_bytes_at_any_number_of_tasks(spark, splits, tmp_path, name):
    df, written = commits(spark, 300).repartition(7), []
    for tasks in (1, 3, 16):
        path = tmp_path / f"{tasks}" / name
        path.parent.mkdir()
        assert recording.write_recording(df, str(path), "r", "https://u:p@h/x", "head", tasks) == 300
        written.append(path.read_bytes())
    assert written[0] == written[1] == written[2]
    text = (gzip.decompress(written[0]) if name.endswith("gz") else written[0]).decode("ascii")
    lines = [json.loads(x) for x in text.splitlines()]
    assert text.endswith("}\n") and lines[0] == {"format": recording.FORMAT, "version": 1, "repo": "r", "url": "https://h/x", "head": "head", "commits": 300}
    want = [recording.commit_record(r.asDict(recursive=True)) for r in df.orderBy("pos").collect()]
    assert lines[1:] == want
    for size in (2000, 1 << 27):
        splits(size)
        back = recording.read_recording(spark, str(path))
        assert sorted(map(str, back.collect())) == sorted(map(str, df.withColumn("files", F.col("files")).collect()))


def test_errors_name_the_same_line_at_any_split(spark, splits, tmp_path):
    path = tmp_path / "h.jsonl"
    recording.write_recording(commits(spark, 60), str(path), "r")
    lines = path.read_text().splitlines()
    lines[41] = lines[41].replace('"sha"', '"sh"')
    path.write_text("\n".join(lines) + "\n")
    for size in (500, 1 << 27):
        splits(size)
        with pytest.raises(Exception, match="line 42: no sha"):
            recording.read_recording(spark, str(path), check=False).collect()


def test_pieces(spark, tmp_path):
    rows = formatted(spark.range(50).repartition(5), ("id",), lambda r: f"<{r['id']}>")
    path = str(tmp_path / "sub" / "x.txt")
    write_pieces(spark, path, ["[", Sorted(rows, ("id",), ", ", tasks=3), "]\n", Sorted(rows.limit(0), ("id",)), Sorted(rows.where("id < 2"), ("id",)), "\n"])
    assert open(path).read() == "[" + ", ".join(f"<{k}>" for k in range(50)) + "]\n<0>\n<1>\n"


def test_recording_of_nothing(spark, tmp_path):
    path = str(tmp_path / "h.jsonl")
    assert recording.write_recording(commits(spark, 1).limit(0), path, "r") == 0
    assert open(path).read().count("\n") == 1 and recording.read_recording(spark, path).count() == 0
