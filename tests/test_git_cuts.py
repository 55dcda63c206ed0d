"""The partitioned scan of clones: cuts, pushed filters, frames of the log, and explain by revision."""

import random

import pytest
from pyspark.sql import functions as F

from gritsieve.plans.engine import Engine
from gritsieve.sources import git_log


@pytest.fixture
def branched(make_repo):
    """Forty commits on two branches that merge now and then, renames, binary files and odd names among them."""
    repo, rng = make_repo("branched"), random.Random(4)
    repo.commit("start", {"src/a.py": "x = 1\n" * 30, "pic.bin": b"\0\1\2" * 50})
    for k in range(40):
        if k % 9 == 4:
            repo.git("checkout", "-q", "-b", f"side{k}")
            repo.commit(f"side {k}\n\nbody \xe9", {f"src/side{k}.py": f"def f{k}():\n    return {k}\n"})
            repo.git("checkout", "-q", "main")
            repo.commit(f"main {k}", {f"docs/{k}.md": "text\n"})
            repo.git("merge", "-q", "--no-edit", f"side{k}")
        elif k % 7 == 3:
            repo.git("mv", "src/a.py" if k % 2 else f"src/a{k - 14}.py" if k > 14 else "src/a.py", f"src/a{k}.py") if k == 3 else None
            repo.commit(f"odd {k}", {f"src/n {k} é\t.py": "y = 2\n", "pic.bin": bytes([k]) * 60, "nul.txt": b"a\0b\n" * k})
        else:
            repo.commit(f"work {k}", {f"src/w{rng.randrange(6)}.py": "".join(f"v{j} = {rng.randrange(9)}\n" for j in range(20))} if k % 5 else {})
    return repo


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def load(spark, path, **options):
    git_log.register(spark)
    return spark.read.format("git_history").options(paths=path, **options).load()


def test_rows_are_those_of_one_walk_at_any_number_of_cuts(spark, branched):
    whole = load(spark, branched.path, cut=1000)
    want = rows(whole)
    assert whole.rdd.getNumPartitions() == 1 and [r[1] for r in want] == list(range(len(want))) and len(want) > 40
    assert [r[2] for r in want] == branched.git("rev-list", "--no-merges", "HEAD").split()
    for cut in (1, 7, 16):
        parts = load(spark, branched.path, cut=cut)
        assert parts.rdd.getNumPartitions() == -(-len(want) // cut) and rows(parts) == want
    assert rows(load(spark, branched.path, cut=5, limit=12)) == want[:12]
    half = branched.git("rev-list", "--no-merges", "--max-count=1", "--skip=10", "HEAD")
    assert {r[2] for r in rows(load(spark, branched.path, cut=3, rev=f"{half}..HEAD"))} == set(branched.git("rev-list", "--no-merges", f"{half}..HEAD").split())


def planned(path, *filters, **options):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringStartsWith

    kinds = {"=": EqualTo, ">=": GreaterThanOrEqual, "in": In, "<": LessThan, "^": StringStartsWith}
    reader = git_log.GitHistoryReader({"paths": path, **options})
    given = [kinds[op]((name,), value) for name, op, value in filters]
    assert list(reader.pushFilters(given)) == given  # Spark applies them too
    return reader.partitions()


def test_filters_prune_commits_before_they_are_diffed(spark, branched):
    want = rows(load(spark, branched.path))
    sha, date = want[20][2], want[8][4]
    (one,) = planned(branched.path, ("sha", "=", sha))
    assert (one.skip, one.count) == (20, 1)
    assert [(c.skip, c.count) for c in planned(branched.path, ("date", ">=", date))] == [(0, 9)]
    assert sum(c.count for c in planned(branched.path, ("sha", "in", (want[3][2], want[30][2])), ("pos", "<", 10))) == 1
    assert sum(c.count for c in planned(branched.path, ("sha", "^", sha[:9]), limit="5")) == 0
    assert sum(c.count for c in planned(branched.path, ("repo", "=", "another"))) == 0
    df = load(spark, branched.path)
    for condition in (F.col("sha") == sha, F.col("sha").startswith(sha[:7]), F.col("date") >= date, (F.col("pos") < 10) & (F.col("date") < date), F.col("sha").isin(sha, want[0][2]), F.col("repo") == "x"):
        assert rows(df.where(condition)) == rows(spark.createDataFrame(want, df.schema).where(condition))
    assert df.where(F.col("sha") == sha).rdd.getNumPartitions() == 1
    assert df.where(F.col("date") >= date).count() == 9


def test_runs_cover_all_places_with_few_ranges():
    rng = random.Random(2)
    for _ in range(50):
        places = sorted(rng.sample(range(3000), rng.randrange(400)))
        for most in (2, 10, 1000):
            found = git_log.runs(places, rng.choice([1, 4, 100]), most)
            covered = [p for a, b in found for p in range(a, b)]
            assert len(found) <= most and set(places) <= set(covered) and covered == sorted(set(covered))
            if most == 1000:
                assert covered == places


def test_a_torn_log_is_refused():
    mark = git_log.MARKER.encode()
    for tokens in ([b"", mark, b"sha", b"p"], [b"stray", mark], [b"", mark, b"s", b"", b"d", b"m", b"not a count", b""], [b"", mark, b"s", b"", b"d", b"m", b"1\t1\t", b"old", b""]):
        with pytest.raises(git_log.GitError):
            list(git_log.parse_log(iter(tokens)))


def test_a_branch_that_moves_does_not_tear_the_walk(spark, branched):
    df = load(spark, branched.path, cut=4)
    cuts = git_log.GitHistoryReader({"paths": branched.path, "cut": "4"}).partitions()
    before = branched.git("rev-list", "--no-merges", "HEAD").split()
    branched.commit("later", {"later.txt": "x\n"})
    reader = git_log.GitHistoryReader({"paths": branched.path})
    assert [row[2] for cut in cuts for row in reader.read(cut)] == before
    assert df.count() == len(before) + 1  # a new plan sees the new head


def test_explain_reads_one_commit(spark, branched, project, capsys):
    from gritsieve.cli import main

    engine = Engine(spark)
    row = engine.explain_revision(project.path, "HEAD~0")
    assert row["sha"] == project.fix and [f["category"] for f in row["files"]] == ["source", "test"] and row["files"][1]["patch"]["asserts"] > 0
    (cut,) = planned(project.path, ("sha", "=", project.fix), rev=project.fix, limit="1")
    assert cut.count == 1
    with pytest.raises(ValueError, match="merge"):
        engine.explain_revision(branched.path, branched.git("rev-list", "--merges", "--max-count=1", "HEAD"))
    assert main(["explain", "main", "--repo", project.path]) == 0
    said = capsys.readouterr().out
    assert "tests/test_app.py" in said and "asserts" in said and "candidate: score" in said
    assert main(["explain", "HEAD~2", "--repo", project.path]) == 0 and "rejected" in capsys.readouterr().out
    assert main(["explain", "no-such", "--repo", project.path]) == 2
