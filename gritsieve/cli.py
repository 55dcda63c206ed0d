"""The command line: ``python -m gritsieve COMMAND``. Exit 1: refused or not new; 2: an error."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritsieve import __version__


def _session() -> SparkSession:
    return SparkSession.builder.appName("gritsieve").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _ascii(text: object) -> str:
    return str(text).encode("ascii", "replace").decode()


def _clip(text: str, width: int) -> str:
    return text if len(text) <= width else text[: width - 3] + "..."


def grid(head: list[str], rows: list[list[object]], right: set[int] = frozenset()) -> str:
    """A fixed-width table."""
    cells = [head, *[[_ascii(c) for c in r] for r in rows]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(head))]
    return "\n".join("  ".join(c.rjust(w) if k in right else c.ljust(w) for k, (c, w) in enumerate(zip(r, widths))).rstrip() for r in cells)


def candidate_grid(rows: list[dict], width: int = 60) -> str:
    head = ["rank", "score", "difficulty", "commit", "date", *(["ledger"] if rows and rows[0].get("status") else []), "subject"]
    body = []
    for r in rows:
        pull = r.get("pull_request")
        name = f"#{pull['number']}" if pull else r["sha"][:10]
        body.append([r["rank"], f"{r['score']:.2f}", f"{r['difficulty']:.2f} {r['band']}", name, r["date"][:10], *([r["status"]] if r.get("status") else []), _clip(r["subject"], width)])
    return grid(head, body, {0, 1})


def file_grid(files: list[dict]) -> str:
    """The files of a commit: category, rule, counts, and what the measurements of their patches saw."""
    body = []
    for f in files:
        counts = ["-" if f[k] is None else f[k] for k in ("added", "deleted")]
        patch, unknown = f["patch"], "-" if "-" in counts else "?"
        seen = [patch[k] for k in ("hunks", "code_hunks")] + [patch["test_added"] + patch["test_deleted"], patch["asserts"]] if patch else [unknown] * 4
        body.append([f["category"], f["rule_id"], *counts, *seen, f"{f['old_path']} -> {f['path']}" if f["old_path"] else f["path"]])
    return grid(["category", "rule", "added", "del", "hunks", "code", "tests", "asserts", "path"], body, set(range(2, 8)))


def explanation(row: dict) -> str:
    """One commit in full."""
    lines = [f"{row['repo']} {row['sha']}", f"date     {row['date']}", f"subject  {_ascii(row['subject'])}"]
    if row.get("files") and "rule_id" in row["files"][0]:
        lines += ["", file_grid(row["files"]), *([f"public API touched: {', '.join(row['public_api'])}"] if row.get("public_api") else []), ""]
    if row["reason"]:
        from gritsieve.schema import REASONS

        return "\n".join([*lines, f"rejected: {row['reason']} ({REASONS[row['reason']]})"])
    lines.append(f"candidate: score {row['score']:.4f}, difficulty {row['difficulty']:.4f} ({row['band']})")
    for name in ("score_features", "difficulty_features"):
        lines += ["", grid([name.split("_")[0], "value", "weight", "contrib", "detail"], [[f["name"], f"{f['value']:.4f}", f"{f['weight']:g}", f"{f['contribution']:.4f}", f["detail"]] for f in row[name]], {1, 2, 3})]
    return "\n".join(lines)


def rules_text(rules, markdown: bool = False) -> str:
    """The rule table as text or as Markdown."""
    rows = [[str(k), r.rule_id, r.category, f"{r.kind}: {' '.join(r.patterns)}" + (f" unless {' '.join(r.unless)}" if r.unless else ""), ", ".join(r.languages) or "any", r.rationale] for k, r in enumerate(rules, 1)]
    head = ["#", "rule", "category", "matches", "languages", "why"]
    if not markdown:
        return grid(head, rows, {0})
    return "\n".join("| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in [head, ["---"] * len(head), *rows])


def _parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="gritsieve", description=__doc__)
    sub = main.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *options: tuple) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        for names, kind in options:
            p.add_argument(*names, **kind)
        return p

    text, flag, whole, part = {}, {"action": "store_true"}, {"type": int}, {"type": float, "default": 0.5}
    tuning = [(["--config"], text), (["--max-lines"], whole), (["--max-source-files"], whole), (["--test-lines-cap"], whole)]
    output = [(["--out"], text), (["--top"], {"type": int, "default": 20}), (["--explain"], {"type": int, "default": 0}), (["--ledger"], text), (["--min-overlap"], part), (["--new-only"], flag)]
    command("mine", "rank the commits of a clone or a recording", (["repo"], {"nargs": "?"}), (["--history"], text), (["--rev"], {"default": "HEAD"}), (["--max-count"], whole), (["--no-content"], flag), (["--name", "--repo-name"], text), (["--url"], text), *tuning, *output)
    command("prs", "rank merged pull requests", (["repo"], text), (["--limit"], {"type": int, "default": 30}), (["--replay"], text), (["--record"], text), (["--max-files"], {"type": int, "default": 300}), (["--token"], text), (["--api-url"], text), (["--cache-dir"], text), (["--no-cache"], flag), (["--max-wait"], {"type": float, "default": 900.0}), *tuning, *output)
    command("batch", "mine several repositories into one ledger", (["config"], text), (["--ledger"], text), (["--out"], text), (["--report"], text), (["--only"], {"action": "append", "default": []}), (["--full"], flag), (["--dry-run"], flag), (["--top"], {"type": int, "default": 10}))
    command("report", "render an export", (["candidates"], text), (["--out"], text), (["--top"], whole), (["--format"], text))
    command("record", "walk a clone once and save it", (["repo"], text), (["--out"], {"required": True}), (["--rev"], {"default": "HEAD"}), (["--max-count"], whole), (["--name", "--repo-name"], text))
    command("explain", "one commit in detail", (["sha"], text), (["--repo"], text), (["--history"], text), (["--name", "--repo-name"], text), (["--no-content"], flag), (["--json"], flag), *tuning)
    command("classify", "classify paths", (["paths"], {"nargs": "+"}), (["--root"], text), (["--config"], text))
    command("rules", "print the rule table", (["--config"], text), (["--markdown"], flag))
    command("ledger-add", "add candidates of an export", (["ledger"], text), (["candidates"], text), (["--sha"], {"action": "append", "default": []}), (["--top"], whole), (["--owner"], text), (["--status"], {"default": "claimed"}), (["--min-overlap"], part), (["--allow-overlap"], flag))
    command("ledger-check", "check candidates of an export", (["ledger"], text), (["candidates"], text), (["--min-overlap"], part))
    command("ledger-list", "list entries", (["ledger"], text), (["--repo"], text))
    command("ledger-watermarks", "list watermarks", (["ledger"], text))
    command("schema", "print the export's schema")
    command("version", "print the version")
    return main


def _settings(a: argparse.Namespace):
    from gritsieve.settings import Settings
    from gritsieve.sources.config import find_config, load_config

    path = a.config or (find_config(a.repo) if getattr(a, "repo", None) else None)
    given = {"max_lines": a.max_lines, "max_source_files": a.max_source_files, "test_lines_cap": a.test_lines_cap}
    return load_config(path).settings(**given) if path else Settings(**{k: v for k, v in given.items() if v is not None})


def _mined(engine, commits: DataFrame, name: str, source: str, a: argparse.Namespace, unit: str, url: str | None = None) -> int:
    from gritsieve.plans.export import write_run
    from gritsieve.streaming.ledger import Ledger

    ledger = Ledger(engine.spark, a.ledger, create=False) if a.ledger else None
    run = engine.run(commits, name, source, _settings(a), unit, url, ledger, a.min_overlap, a.new_only)
    rows = run.judged().where("status = 'new'") if a.new_only else run.judged()
    best = [r.asDict(recursive=True) for r in rows.orderBy("rank").limit(max(a.top, a.explain)).collect()]
    print(candidate_grid(best[: a.top]) if best else "no candidates")
    for row in best[: a.explain]:
        print("\n" + explanation(row))
    if a.out:
        write_run(a.out, run)
    return 0


def _run(a: argparse.Namespace) -> int:
    from gritsieve.operators.rules import RULES

    if a.command == "version":
        print(__version__)
        return 0
    if a.command == "schema":
        from gritsieve.plans.json_schema import schema_text

        print(schema_text())
        return 0
    if a.command == "rules":
        from gritsieve.sources.config import load_config

        print(rules_text(load_config(a.config).rules if a.config else RULES, a.markdown))
        return 0
    if a.command == "report":
        from gritsieve.plans.report import render

        text = render(a.candidates, a.out, a.top, a.format)
        if not a.out:
            print(text)
        return 0
    from gritsieve.plans.engine import Engine

    spark = _session()
    engine = Engine(spark)
    if a.command == "explain":
        if a.repo and a.history:
            raise ValueError("give --repo or --history, not both")
        if a.history:
            row = engine.explain(engine.history(a.history), a.sha, _settings(a))
        else:
            a.repo = a.repo or "."
            row = engine.explain_revision(a.repo, a.sha, _settings(a), not a.no_content, a.name)
        if a.json:
            import json

            from gritsieve.plans.export import explain_record

            print(json.dumps(explain_record(row, _settings(a), a.name or row["repo"]), sort_keys=True))
        else:
            print(explanation(row))
        return 0
    if a.command == "mine":
        if bool(a.repo) == bool(a.history):
            raise ValueError("give a clone or --history")
        name = a.name
        if a.history:
            commits = engine.history(a.history, a.max_count)
            head = commits.select("repo").first()
            name = name or (head[0] if head else "history")
        else:
            commits = engine.clone(a.repo, a.rev, a.max_count, not a.no_content)
            name = name or a.repo.rstrip("/").rsplit("/", 1)[-1]
        return _mined(engine, commits, name, "history" if a.history else "clone", a, "commits", a.url)
    if a.command == "prs":
        import os

        from gritsieve.sources import pull_source, pulls

        token, api = a.token or os.environ.get("GITHUB_TOKEN"), a.api_url or os.environ.get("GITHUB_API_URL") or pulls.API
        if a.record:
            client = pulls.Client(token, api, pulls.Cache(a.cache_dir) if a.cache_dir and not a.no_cache else None, max_wait=a.max_wait)
            pulls.record(client, a.repo, a.record, a.limit, max_files=a.max_files)
            print(client.stats.describe(), file=sys.stderr)
        if a.replay or a.record:
            commits = engine.pull_requests(a.replay or a.record, limit=a.limit, max_files=a.max_files).where(F.col("repo") == a.repo)
        else:
            commits, _ = pull_source.pull_requests(spark, a.repo, {"token": token, "api": api, "max_wait": str(a.max_wait), "cache": None if a.no_cache else a.cache_dir}, limit=a.limit, max_files=a.max_files)
        name, a.repo = a.repo, None
        return _mined(engine, commits, name, "pull-requests", a, "pull requests", f"https://github.com/{name}")
    if a.command == "batch":
        from gritsieve.plans.engine import best_new
        from gritsieve.plans.export import write_batch
        from gritsieve.plans.report import render
        from gritsieve.sources.config import load_batch
        from gritsieve.streaming.ledger import Ledger

        config = load_batch(a.config)
        out, report = a.out or config.out, a.report or config.report

        def finish(result) -> None:
            if out:
                write_batch(spark, out, result)
                if report:
                    render(out, report)

        result = engine.batch(config, Ledger(spark, a.ledger or config.ledger), tuple(a.only), a.full, a.dry_run, finish)
        for run in result.runs:
            print(f"{run.repo} [{run.source}]: " + (f"failed: {run.error}" if run.error else f"{run.resume.mode}, walked {run.outcomes.count()} {run.unit}, {run.resume.skipped} evaluated before"))
        judged = result.judged()
        if judged is not None and not all(r.outcomes.isEmpty() for r in result.done):
            best = [r.asDict(recursive=True) for r in best_new(judged, a.top).collect()]
            print(candidate_grid(best) if best else "no new candidates")
        return 2 if result.failed else 0
    if a.command == "record":
        print(f"{engine.record(a.repo, a.out, a.rev, a.max_count, a.name)} commits")
        return 0
    if a.command == "classify":
        from gritsieve.sources.config import load_config
        from gritsieve.sources.contents import working_tree

        rows = spark.createDataFrame([(p,) for p in a.paths], "path string")
        rows = rows.join(working_tree(spark, a.root), "path", "left") if a.root else rows.withColumn("signals", F.lit(None).cast("array<string>"))
        found = engine.classify(rows, load_config(a.config).rules if a.config else RULES).orderBy("path").collect()
        print(grid(["path", "category", "rule"], [[r["path"], r["category"], r["rule_id"]] for r in found]))
        return 0
    from gritsieve.plans.export import read_candidates
    from gritsieve.streaming.ledger import Ledger

    ledger = Ledger(spark, a.ledger, create=a.command == "ledger-add")
    if a.command == "ledger-list":
        print(grid(["id", "repo", "sha", "status", "owner", "first seen", "hunks", "subject"], [[r["id"], r["repo"], r["sha"][:10], r["status"], r["owner"] or "-", r["first_seen"], r["hunk_count"], _clip(r["subject"], 50)] for r in ledger.entries(a.repo).collect()], {0, 6}))
        return 0
    if a.command == "ledger-watermarks":
        print(grid(["repo", "source", "position", "walked", "runs", "updated"], [[r[c] for c in ("repo", "source", "position", "walked", "runs", "updated")] for r in ledger.watermarks().collect()], {3, 4}))
        return 0
    rows = read_candidates(spark, a.candidates)
    if a.command == "ledger-check":
        found = ledger.check(rows.select("ord", "repo", "sha", "subject", "fingerprint"), a.min_overlap).join(rows.select("ord", "repo", "sha"), "ord").orderBy("ord").collect()
        print(grid(["repo", "sha", "verdict", "matches"], [[r["repo"], r["sha"][:10], r["status"], len(r["matches"])] for r in found], {3}))
        return int(any(r["status"] != "new" for r in found))
    if a.sha:
        chosen = F.lit(False)
        for prefix in a.sha:
            chosen = chosen | F.col("sha").startswith(prefix)
        rows = rows.where(chosen)
    refused = 0
    for r in rows.orderBy("ord").limit(a.top or (1 << 30)).toLocalIterator():
        entry, verdict = ledger.add({"repo": r["repo"], "sha": r["sha"], "subject": r["subject"], "hunks": r["fingerprint"]["hunks"] if r["fingerprint"] else []}, a.status, a.owner, None if a.allow_overlap else a.min_overlap)
        refused += entry is None
        print(f"{r['repo']} {r['sha'][:10]}: {'added' if entry else verdict['status']}")
    return int(refused > 0)


def main(args: list[str] | None = None) -> int:
    try:
        return _run(_parser().parse_args(args))
    except (ValueError, RuntimeError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
