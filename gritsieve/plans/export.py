"""Export records: one run's funnel, then its candidates in rank order, as JSON lines.

Keys are sorted and text is ASCII, so the same results give the same bytes. A file is one ordered
artefact: its lines, and the list of rejected commits inside a run's line, are made and sorted by the cluster and
joined in blocks. The driver holds counts and summaries only, and the collisions of a batch, which are one line of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gritsieve import __version__
from gritsieve.operators import summaries
from gritsieve.operators.dedupe import fingerprint_of
from gritsieve.operators.rules import RULES, classify
from gritsieve.operators.stats import explode_files
from gritsieve.plans.engine import BatchResult, Run, collisions
from gritsieve.plans.json_schema import record_fault
from gritsieve.scratch import Scratch
from gritsieve.sources.ordered import Sorted, formatted, numbered_lines, write_pieces
from gritsieve.schema import BANDS, EXPORT_VERSION, FINGERPRINT_VERSION, REASONS, STATUSES


class ExportError(ValueError):
    """An export is not what it should be."""


def match_record(match: dict) -> dict:
    smaller = match["smaller"]
    return {
        "repo": match["repo"], "sha": match["sha"], "subject": match["subject"], "status": match["status"], "owner": match["owner"], "first_seen": match["first_seen"],
        "shared": match["shared"], "hunks": smaller, "overlap": round(match["shared"] / smaller, 4) if smaller else 0.0, "exact": match["exact"], "source": "run" if match["in_run"] else "ledger",
    }


def verdict_record(status: str | None, matches: list[dict] | None) -> dict | None:
    return None if status is None else {"status": status, "matches": [match_record(m) for m in matches or []]}


def _file_record(file: dict) -> dict:
    out = {k: file[k] for k in ("path", "category", "added", "deleted")} | {"rule": file["rule_id"]}
    out |= {k: file[k] for k in ("old_path", "signals") if file[k]}
    if file["patch"]:
        out["patch"] = {k: v for k, v in file["patch"].items() if k != "hunk_hashes"}
    return out


def candidate_record(row: dict, url: str | None, files: list[dict]) -> dict:
    """One self-contained candidate."""
    source = [f for f in files if f["category"] == "source"]
    inline = [f["path"] for f in source if "rust-tests-added" in (f["signals"] or []) or (f["patch"] or {}).get("test_added", 0) > 0]
    print_ = row["fingerprint"]
    return {
        "kind": "candidate", "schema_version": EXPORT_VERSION, "rank": row["rank"], "repo": row["repo"], "repo_url": url, "sha": row["sha"],
        "base": row["parents"][0] if row["parents"] else None, "date": row["date"], "subject": row["subject"], "score": row["score"], "features": row["score_features"],
        "difficulty": {"value": row["difficulty"], "band": row["band"], "features": row["difficulty_features"]}, "public_api": row["public_api"] or [],
        "lines": {"changed": row["changed_lines"], **{k: row[k] for k in ("source_added", "source_deleted", "test_added", "test_deleted")}},
        "source_files": row["source_paths"], "test_files": row["test_paths"], "inline_test_files": inline, "fail_to_pass": row["fail_to_pass"],
        "files": [_file_record(f) for f in files], "fingerprint": print_ and {"version": FINGERPRINT_VERSION, "patch": print_["patch"], "hunks": print_["hunks"]},
        "ledger": verdict_record(row.get("status"), row.get("matches")), "pull_request": row.get("pull_request"),
    }


def _with_files(rows: DataFrame, rules) -> DataFrame:
    """Candidates with their classified files, in the order of the commit."""
    files = classify(explode_files(rows.select("repo", "sha", "files")), rules)
    listed = files.groupBy("repo", "sha").agg(F.array_sort(F.collect_list(F.struct("pos_in_commit", "path", "category", "rule_id", "added", "deleted", "old_path", "signals", "patch"))).alias("classified"))
    return rows.drop("files").join(listed, ["repo", "sha"], "left")


def _candidates(run: Run) -> DataFrame:
    """(rank, line) of the exported candidates."""
    rows = run.judged()
    rows = rows.where("status = 'new'") if run.new_only else rows
    url = run.url
    listed = _with_files(rows, run.settings.rules or RULES)
    return formatted(listed, ("rank",), lambda row: json.dumps(candidate_record(row, url, row["classified"]), sort_keys=True))


def _rejected(run: Run) -> DataFrame:
    """(pos, line) of the rejected commits."""
    number = F.col("pull_request.number") if "pull_request" in run.outcomes.columns else F.lit(None).cast("long")
    rows = run.outcomes.where("reason is not null").select("pos", "sha", "date", "subject", "reason", number.alias("pull_request"))
    return formatted(rows, ("pos",), lambda row: json.dumps({k: v for k, v in row.items() if k != "pos"}, sort_keys=True))


def run_record(run: Run, exported: int) -> dict:
    """The funnel of a run; its ``rejections`` are left empty."""
    rows = run.outcomes
    reasons = {r["reason"]: r["n"] for r in summaries.reason_counts(rows, []).orderBy("ord").collect()}
    bands = {r["band"]: r["n"] for r in summaries.band_counts(rows, []).orderBy("ord").collect()}
    total = rows.count()
    ledger = None
    if run.ledger is not None:
        counts = {r["status"]: r["count"] for r in run.judged().groupBy("status").count().collect()}
        ledger = {"path": run.ledger, "min_overlap": run.min_overlap, "new_only": run.new_only, "counts": {s: counts.get(s, 0) for s in STATUSES}}
    return {
        "kind": "run", "schema_version": EXPORT_VERSION, "engine": __version__, "repo": run.repo, "url": run.url, "source": run.source, "unit": run.unit, "walked": total,
        "candidates": total - sum(reasons.values()), "bands": {b: bands[b] for b in BANDS if b in bands}, "rejected": {r: reasons[r] for r in REASONS if r in reasons}, "rejections": [],
        "ledger": ledger, "exported": exported, "settings": run.settings.to_json(), "resume": run.resume and vars(run.resume),
    }


def run_pieces(run: Run) -> Iterator[str | Sorted]:
    """A run's line and its candidates' lines, in pieces that are sorted by the cluster."""
    candidates = Scratch(run.outcomes.sparkSession, "export").stash(_candidates(run), "candidates")
    exported = candidates.count()
    # keys are sorted, so what stands before the empty list is written first, the rejected commits go inside of it
    before, after = json.dumps(run_record(run, exported), sort_keys=True).split('"rejections": []')
    yield before + '"rejections": ['
    yield Sorted(_rejected(run), ("pos",), ", ")
    yield "]" + after + "\n"
    if exported:
        yield Sorted(candidates, ("rank",))
        yield "\n"


def batch_pieces(batch: BatchResult) -> Iterator[str | Sorted]:
    """The batch with its collisions, then every run."""
    judged, found = batch.judged(), []
    if judged is not None:
        for row in collisions(judged.withColumn("rank", F.col("rank"))).join(judged.select("repo", "sha", "run_ord"), ["repo", "sha"]).orderBy("run_ord", "rank").collect():
            held = row.asDict(recursive=True)
            found.append({k: held[k] for k in ("repo", "sha", "subject", "rank", "status", "same_commit")} | {"match": match_record(held["match"])})
    head = {
        "kind": "batch", "schema_version": EXPORT_VERSION, "engine": __version__, "config": batch.config.path, "ledger": batch.config.ledger, "min_overlap": batch.config.min_overlap,
        "dry_run": batch.dry_run, "full": batch.full, "runs": len(batch.done), "failed": [{"repo": r.repo, "source": r.source, "error": r.error} for r in batch.failed], "collisions": found,
    }
    yield json.dumps(head, sort_keys=True) + "\n"
    for run in batch.done:
        yield from run_pieces(run)


def explain_record(outcome: dict, settings, repo: str) -> dict:
    """One commit: its candidate record, or the reason it was rejected for, and its files."""
    files = {"files": [_file_record(f) for f in outcome.get("files") or [] if "rule_id" in f]}
    return _verdict_of(outcome, settings, repo) | files


def _verdict_of(outcome: dict, settings, repo: str) -> dict:
    if outcome["reason"] is None:
        return {"kind": "explanation", "repo": repo, "verdict": "candidate", "candidate": {k: outcome[k] for k in ("sha", "subject", "score", "score_features", "difficulty", "band", "difficulty_features", "fail_to_pass", "public_api")}}
    return {"kind": "explanation", "repo": repo, "verdict": "rejected", "sha": outcome["sha"], "subject": outcome["subject"], "reason": outcome["reason"], "description": REASONS[outcome["reason"]], "settings": settings.to_json()}


def write_run(path: str, run: Run) -> None:
    write_pieces(run.outcomes.sparkSession, path, run_pieces(run))


def write_batch(spark: SparkSession, path: str, batch: BatchResult) -> None:
    write_pieces(spark, path, batch_pieces(batch))


# --- reading -----------------------------------------------------------------------------------

CANDIDATE = "kind string, schema_version int, rank int, repo string, sha string, subject string, fingerprint struct<version:int,patch:string,hunks:array<string>>"


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Proposals of an export in its order; fingerprints are checked against their hunks."""
    rows = numbered_lines(spark, path).where(F.trim("line") != "")
    rows = rows.select(F.col("pos").alias("ord"), F.from_json("line", CANDIDATE).alias("r")).where("r.kind = 'candidate'")
    own = fingerprint_of(F.col("r.fingerprint.hunks"))
    bad = (F.col("r.fingerprint.version") != FINGERPRINT_VERSION) | (own["patch"] != F.col("r.fingerprint.patch")) | ~F.col("r.schema_version").between(3, EXPORT_VERSION)
    good = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit(f"{path}, line "), (F.col("ord") + 1).cast("string"), F.lit(": version or fingerprint do not fit"))).cast("boolean")).otherwise(True)
    return rows.where(good).select("ord", "r.repo", "r.sha", "r.subject", "r.rank", F.when(F.col("r.fingerprint").isNotNull(), own).alias("fingerprint"))


def read_export(path: str) -> tuple[dict | None, list[tuple[dict, list[dict]]]]:
    """The batch record or None, and each run with its candidates; counts must agree."""
    batch, runs = None, []
    with open(path, encoding="utf-8") as file:
        for number, line in enumerate(file, 1):
            if not line.strip():
                continue
            try:
                record = json.loads(line)
                kind = record["kind"]
            except (ValueError, KeyError, TypeError):
                raise ExportError(f"{path}, line {number}: no record") from None
            if record.get("schema_version") not in (5, EXPORT_VERSION):
                raise ExportError(f"{path}, line {number}: version {record.get('schema_version')!r} is not known")
            if fault := record_fault(record):
                raise ExportError(f"{path}, line {number}: {fault}")
            if kind == "batch" and number == 1:
                batch = record
            elif kind == "run":
                runs.append((record, []))
            elif kind == "candidate" and runs:
                runs[-1][1].append(record)
            else:
                raise ExportError(f"{path}, line {number}: a {kind} record is out of place")
    if not runs and batch is None:
        raise ExportError(f"{path}: there is no run")
    if batch is not None and batch["runs"] != len(runs):
        raise ExportError(f"{path}: {batch['runs']} runs are announced, {len(runs)} are there")
    for run, candidates in runs:
        if run["exported"] != len(candidates):
            raise ExportError(f"{path}: {run['repo']} announces {run['exported']} candidates and has {len(candidates)}")
    return batch, runs


def segments(records: DataFrame, kind: str = "kind", order: Sequence[str] = ("pos",), keys: Sequence[str] = ()) -> DataFrame:
    """Records with the number of the run they belong to: a running count of the records that open one.

    ``keys`` name the file that a record is of; without any, all records are of one file.
    """
    file = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("run", F.sum((F.col(kind) == "run").cast("int")).over(file))
