import json
import os

import pytest
from pyspark.sql import functions as F

from gritsieve.cli import main
from gritsieve.plans.engine import Engine, evaluate, mine
from gritsieve.plans.export import ExportError, read_candidates, read_export, write_run
from gritsieve.plans.report import render, web_url
from gritsieve.sources.config import ConfigError, load_batch, parse_config
from gritsieve.sources.recording import read_headers, read_recording, write_recording
from gritsieve.streaming.ledger import Ledger


def test_clone_is_mined(spark, project):
    commits = Engine(spark).clone(project.path)
    rows = {r["subject"]: r for r in mine(commits).collect()}
    assert {s: r["reason"] for s, r in rows.items()} == {
        "Initial import": None, "Describe the app": "docs-only", "Reword a comment": "source-cosmetic", "Speed up": "no-test", "Fix crash on empty text": None,
    }
    fix = rows["Fix crash on empty text"]
    assert fix["rank"] == 1 and fix["fail_to_pass"] == ["tests/test_app.py::test_empty"]
    assert {f["name"]: (f["value"], f["detail"]) for f in fix["score_features"]} == {
        "small_diff": (0.9825, "7 of at most 400 source+test lines changed"), "test_lines_added": (0.125, "5 test lines added (full value at 40)"),
        "added_assertions": (0.4, "2 assertion lines added in tests (full value at 5)"), "linked_reference": (1.0, "Closes #12"),
        "fix_keyword": (1.0, "Fix"), "focused_source": (1.0, "1 source file changed"),
    }
    assert fix["score"] == pytest.approx(2.9475 + 0.25 + 0.4 + 2 + 1 + 1)
    assert fix["difficulty"] == pytest.approx(0.2 + 0.3 + 0.06) and fix["band"] == "easy"


def test_limit_and_content_options(spark, project):
    engine = Engine(spark)
    assert [r["sha"] for r in engine.clone(project.path, limit=1).collect()] == [project.fix]
    bare = engine.clone(project.path, limit=1, content=False).first()
    assert all(f["signals"] == [] for f in bare["files"])


def test_recording_round_trip(spark, project, tmp_path):
    engine = Engine(spark)
    path = str(tmp_path / "history.jsonl.gz")
    assert engine.record(project.path, path) == 5
    first = open(path, "rb").read()
    engine.record(project.path, path)
    assert open(path, "rb").read() == first
    live = engine.clone(project.path).orderBy("pos").collect()
    replayed = engine.history(path).orderBy("pos").collect()
    assert [r.asDict(True) for r in live] == [r.asDict(True) for r in replayed]
    assert read_headers(spark, path).first()["commits"] == 5


def test_recording_errors(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    head = {"format": "x-history", "version": 1, "repo": "r", "url": None, "head": None, "commits": 1}
    good = {"sha": "a", "parents": [], "date": "2024-01-01T00:00:00Z", "message": "m", "files": [{"path": "a.py", "added": 1, "deleted": 0, "patch": {"hunks": 1}}]}
    path.write_text(json.dumps(head) + "\n" + json.dumps(good) + "\n")
    file = read_recording(spark, str(path)).first()["files"][0]
    assert file["patch"]["code_hunks"] == 1 and file["patch"]["code_added"] == 1 and file["patch"]["hunk_hashes"] is None
    for change in ({"files": [{"path": "a.py", "added": None, "deleted": None, "patch": {"hunks": 1}}]}, {"files": [{"path": "a", "added": 1, "deleted": 0, "patch": {"hunks": 1, "x": 2}}]}, {"sha": None}):
        path.write_text(json.dumps(head) + "\n" + json.dumps(good | change) + "\n")
        with pytest.raises(Exception, match="line 2"):
            read_recording(spark, str(path), check=False).collect()
    path.write_text(json.dumps(head | {"commits": 2}) + "\n" + json.dumps(good) + "\n")
    with pytest.raises(ValueError, match="says 2 commits"):
        read_recording(spark, str(path))


def _batch_file(tmp_path, upstream, fork):
    path = tmp_path / "gritsieve.toml"
    path.write_text(f'[batch]\nledger = "ledger"\nout = "out.jsonl"\n\n[[batch.repos]]\nname = "up"\nclone = "{upstream.path}"\n\n[[batch.repos]]\nname = "fork"\nclone = "{fork.path}"\n\n[[batch.repos]]\nname = "gone"\nclone = "{tmp_path}/none"\n')
    return str(path)


def test_batch_resumes_and_collides(spark, project, make_repo, tmp_path):
    fork = make_repo("fork")
    fork.commit("Initial import of a fork", {"lib/app.py": PARSER_TABS, "tests/test_app.py": "def test_x():\n    assert True\n", "README.md": "# Fork\n"})
    fork.commit("Port the fix", {"lib/app.py": PARSER_TABS.replace("return text", "return text or ''"), "tests/test_app.py": "def test_x():\n    assert True\n\n\ndef test_empty():\n    assert parse(None) == ''\n    assert parse('') == ''\n"})
    config, engine = load_batch(_batch_file(tmp_path, project, fork)), Engine(spark)
    ledger = Ledger(spark, config.ledger)
    dry = engine.batch(config, ledger, dry_run=True)
    assert ledger.state().number == 0 and len(dry.failed) == 1 and dry.failed[0].repo == "gone"
    result = engine.batch(config, ledger)
    assert ledger.state().number == 1
    judged = {(r["repo"], r["subject"]): (r["status"], r["outcome"]) for r in result.judged().collect()}
    assert judged[("up", "Fix crash on empty text")] == ("new", "new")
    assert judged[("fork", "Port the fix")][1] == "collision"
    assert [r.resume.mode for r in result.done] == ["first", "first"]
    marks = {r["repo"]: (r["walked"], r["runs"]) for r in ledger.watermarks().collect()}
    assert marks == {"up": (5, 1), "fork": (2, 1)}
    again = engine.batch(config, ledger)
    assert [r.resume.mode for r in again.done] == ["up-to-date", "up-to-date"]
    project.commit("Fix wrong helper (#13)", {"src/app.py": "def parse(text):\n    return text or ''\n\n\ndef helper(x):\n    return 2 + x\n", "tests/test_app.py": "def test_helper():\n    assert helper(1) == 3\n"})
    more = engine.batch(config, ledger, only=("up",))
    assert more.runs[0].resume.mode == "resumed" and more.runs[0].outcomes.count() == 1
    full = engine.batch(config, ledger, only=("up",), full=True)
    assert {r["outcome"] for r in full.judged().collect()} == {"recorded"}
    assert {r["repo"]: (r["walked"], r["runs"]) for r in ledger.watermarks().collect()}["up"] == (12, 4)


PARSER_TABS = "def parse(text):\n\treturn text\n"


def test_failed_finish_keeps_nothing(spark, project, tmp_path):
    config = load_batch(_batch_file(tmp_path, project, project))
    ledger = Ledger(spark, config.ledger)

    def fail(result):
        raise OSError("disk full")

    with pytest.raises(OSError):
        Engine(spark).batch(config, ledger, finish=fail)
    assert ledger.state().number == 0 and ledger.entries().count() == 0


def test_export_and_report(spark, project, tmp_path):
    engine, out = Engine(spark), str(tmp_path / "out.jsonl")
    run = engine.run(engine.clone(project.path), "o/<r>", "clone", url="https://user:token@github.com/o/r.git", ledger=Ledger(spark, str(tmp_path / "l")))
    write_run(out, run)
    lines = [json.loads(x) for x in open(out)]
    assert [json.dumps(x, sort_keys=True) + "\n" for x in lines] == open(out).readlines() and [x["kind"] for x in lines] == ["run", "candidate", "candidate"]
    assert lines[0]["rejected"] == {"docs-only": 1, "source-cosmetic": 1, "no-test": 1} and lines[0]["walked"] == 5 and "token" not in json.dumps(lines)
    batch, runs = read_export(out)
    assert batch is None and len(runs[0][1]) == 2
    proposals = read_candidates(spark, out).orderBy("ord").collect()
    assert [p["rank"] for p in proposals] == [1, 2] and proposals[0]["fingerprint"]["patch"] == lines[1]["fingerprint"]["patch"]
    text, page = render(out), render(out, str(tmp_path / "r.html"))
    assert "rejected: docs-only" in text and "Fix crash on empty text" in text and "https://github.com/o/r/commit/" in text
    assert "o/&lt;r&gt;" in page and "<script" not in page and page.count("<details>") == page.count("</details>") == 5
    steps = [line.split(" | ") for line in text.splitlines() if line.startswith(("| walked", "| rejected", "| candidates", "| ledger: new", "| exported"))]
    assert [(s[1], s[2].rstrip(" |")) for s in steps] == [("5", "5"), ("1", "4"), ("1", "3"), ("1", "2"), ("2", "2"), ("2", "2"), ("2", "2")]
    lines[0]["exported"] = 3
    open(out, "w").write("".join(json.dumps(x) + "\n" for x in lines))
    with pytest.raises(ExportError, match="announces 3"):
        read_export(out)
    lines[1]["fingerprint"]["patch"] = "0" * 16
    open(out, "w").write("".join(json.dumps(x) + "\n" for x in lines))
    with pytest.raises(Exception, match="do not fit"):
        read_candidates(spark, out).collect()


def test_explain(spark, project):
    engine = Engine(spark)
    commits = engine.clone(project.path)
    assert engine.explain(commits, project.fix[:8])["reason"] is None
    with pytest.raises(ValueError):
        engine.explain(commits, "abc")


def test_web_url():
    assert web_url("git@github.com:o/r.git") == "https://github.com/o/r"
    assert web_url("ssh://git@host:22/o/r") == "https://host/o/r"
    assert web_url("https://t@github.com/o/r/") == "https://github.com/o/r"
    assert web_url("/local") is None


@pytest.mark.parametrize("data, message", [
    ({"filtr": {}}, "unknown key 'filtr'"), ({"filter": {"max_lines": 0}}, "below 1"), ({"filter": {"max_lines": True}}, "whole number"),
    ({"score": {"weights": {"small_diff": -1}}}, "from 0 up"), ({"difficulty": {"medium_at": 9.0}}, "out of order"),
    ({"classify": {"disable": ["nope"]}}, "unknown rule"), ({"classify": {"rules": [{"id": "x", "category": "test", "dirs": ["a/b"], "rationale": "r"}]}}, "no slash"),
    ({"classify": {"rules": [{"id": "x", "category": "test", "dirs": ["a"], "names": ["b"], "rationale": "r"}]}}, "exactly one"),
])
def test_config_errors(data, message):
    with pytest.raises(ConfigError, match=message):
        parse_config(data, "c.toml")


def test_config_tunes(spark, project):
    config = parse_config({"classify": {"rules": [{"id": "src-docs", "category": "docs", "dirs": ["src"], "rationale": "r"}]}, "filter": {"max_lines": 5}, "score": {"test_lines_cap": 7, "weights": {"small_diff": 0.1}}}, "c.toml")
    rows = {r["subject"]: r["reason"] for r in evaluate(Engine(spark).clone(project.path), config.settings()).collect()}
    assert rows["Fix crash on empty text"] == "no-source"
    tuned = parse_config({"score": {"test_lines_cap": 7, "weights": {"small_diff": 0.1}}}, "c.toml").settings(max_lines=None)
    fix = [r for r in evaluate(Engine(spark).clone(project.path), tuned).collect() if r["subject"].startswith("Fix")][0]
    assert fix["score"] == round(round(0.1 * 0.9825, 4) + round(2 * round(5 / 7, 4), 4) + 0.4 + 2 + 1 + 1, 4)


def test_commands(spark, project, tmp_path, capsys):
    out, ledger = str(tmp_path / "o.jsonl"), str(tmp_path / "ledger")
    assert main(["mine", project.path, "--name", "p", "--out", out, "--explain", "1"]) == 0
    assert "Fix crash on empty text" in capsys.readouterr().out
    assert main(["ledger-add", ledger, out, "--sha", project.fix[:10], "--status", "proposed"]) == 0
    assert main(["ledger-add", ledger, out, "--sha", project.fix[:10], "--owner", "me"]) == 0
    assert main(["ledger-add", ledger, out, "--sha", project.fix[:10]]) == 1
    assert main(["ledger-check", ledger, out]) == 1
    assert main(["ledger-list", ledger]) == 0
    assert "claimed" in capsys.readouterr().out
    assert main(["classify", "src/a.py", "docs/x.md"]) == 0 and "py-source" in capsys.readouterr().out
    assert main(["rules", "--markdown"]) == 0 and "vendored-dir" in capsys.readouterr().out
    assert main(["report", out]) == 0 and "Funnel" in capsys.readouterr().out
    assert main(["explain", project.fix[:10], "--repo", project.path, "--json"]) == 0 and '"candidate"' in capsys.readouterr().out
    assert main(["schema"]) == 0 and main(["version"]) == 0
    assert main(["mine"]) == 2 and main(["report", str(tmp_path / "none")]) == 2
