"""JSON Schemas of the export's records, and what checks rows against them.

A schema is compiled to one native expression over a parsed line (``first_fault``): the path and the reason of the first
fault in the order of the schema, null for a good record. Lines are so checked where they are read, by splits. The
few records that Python reads itself are checked by the same schema (``fault_of``), with the same words.

The vocabulary is what the records need: type, enum, const, minimum, required, properties, additionalProperties (false),
items and anyOf with null.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gritsieve.schema import BANDS, CATEGORIES, EXPORT_VERSION, REASONS, STATUSES
from gritsieve.sources.ordered import numbered_lines

TEXT, INTEGER, NUMBER, FLAG = {"type": "string"}, {"type": "integer"}, {"type": "number"}, {"type": "boolean"}
COUNT = {"type": "integer", "minimum": 0}


def _list(items: dict) -> dict:
    return {"type": "array", "items": items}


def _object(required: dict, optional: dict | None = None, more: bool = False) -> dict:
    return {"type": "object", "required": list(required), "properties": required | (optional or {}), "additionalProperties": more}


def _or_null(schema: dict) -> dict:
    return {"anyOf": [schema, {"type": "null"}]}


TEXTS = _list(TEXT)
FEATURE = _object({"name": TEXT, "value": NUMBER, "weight": NUMBER, "contribution": NUMBER, "detail": _or_null(TEXT)})
PATCH = _object({k: COUNT for k in ("hunks", "code_hunks", "code_added", "code_deleted", "test_added", "test_deleted", "asserts")} | {"api": TEXTS, "tests": TEXTS})
FILE = _object({"path": TEXT, "category": {"enum": list(CATEGORIES)}, "rule": TEXT, "added": _or_null(COUNT), "deleted": _or_null(COUNT)}, {"old_path": TEXT, "signals": TEXTS, "patch": PATCH})
MATCH = _object({
    "repo": TEXT, "sha": TEXT, "subject": TEXT, "status": TEXT, "owner": _or_null(TEXT), "first_seen": TEXT, "shared": COUNT, "hunks": COUNT, "overlap": NUMBER, "exact": FLAG, "source": {"enum": ["run", "ledger"]},
})
PULL = _object({"number": COUNT}, {k: _or_null(TEXT) for k in ("url", "title", "merged_at", "base_ref", "base_sha", "head_sha", "merge_commit_sha")} | {k: _or_null(TEXTS) for k in ("labels", "linked_issues", "commits")})
VERSION = {"enum": [5, EXPORT_VERSION]}

SCHEMAS: dict[str, dict] = {
    "batch": _object({
        "kind": {"const": "batch"}, "schema_version": VERSION, "engine": TEXT, "config": TEXT, "ledger": TEXT, "min_overlap": _or_null(NUMBER), "dry_run": FLAG, "full": FLAG, "runs": COUNT,
        "failed": _list(_object({"repo": TEXT, "source": TEXT, "error": TEXT})),
        "collisions": _list(_object({"repo": TEXT, "sha": TEXT, "subject": TEXT, "rank": COUNT, "status": {"enum": ["duplicate", "overlap"]}, "same_commit": FLAG, "match": MATCH})),
    }),
    "run": _object({
        "kind": {"const": "run"}, "schema_version": VERSION, "engine": TEXT, "repo": TEXT, "url": _or_null(TEXT), "source": TEXT, "unit": TEXT, "walked": COUNT, "candidates": COUNT,
        "bands": _object({}, {b: COUNT for b in BANDS}), "rejected": _object({}, {r: COUNT for r in REASONS}),
        "rejections": _list(_object({"sha": TEXT, "date": TEXT, "subject": TEXT, "reason": {"enum": list(REASONS)}, "pull_request": _or_null(COUNT)})),
        "ledger": _or_null(_object({"path": TEXT, "min_overlap": _or_null(NUMBER), "new_only": FLAG, "counts": _object({s: COUNT for s in STATUSES})})), "exported": COUNT,
        "settings": {"type": "object"}, "resume": _or_null({"type": "object"}),
    }),
    "candidate": _object({
        "kind": {"const": "candidate"}, "schema_version": VERSION, "rank": {"type": "integer", "minimum": 1}, "repo": TEXT, "repo_url": _or_null(TEXT), "sha": TEXT, "base": _or_null(TEXT), "date": TEXT, "subject": TEXT,
        "score": NUMBER, "features": _list(FEATURE), "difficulty": _object({"value": NUMBER, "band": {"enum": list(BANDS)}, "features": _list(FEATURE)}), "public_api": TEXTS,
        "lines": _object({k: COUNT for k in ("changed", "source_added", "source_deleted", "test_added", "test_deleted")}), "source_files": TEXTS, "test_files": TEXTS, "inline_test_files": TEXTS,
        "fail_to_pass": TEXTS, "files": _list(FILE), "fingerprint": _or_null(_object({"version": COUNT, "patch": TEXT, "hunks": TEXTS})),
        "ledger": _or_null(_object({"status": {"enum": list(STATUSES)}, "matches": _list(MATCH)})), "pull_request": _or_null(PULL),
    }),
}


def schema_text() -> str:
    """The JSON Schema of a line of an export."""
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "a line of an export", "oneOf": list(SCHEMAS.values())}, indent=2, sort_keys=True)


def _expected(schema: dict) -> str:
    if "anyOf" in schema:
        return f"{_expected(schema['anyOf'][0])} or null"
    if "const" in schema or "enum" in schema:
        return "one of " + ", ".join(map(str, schema.get("enum", [schema.get("const")])))
    return schema["type"] + (f" of at least {schema['minimum']}" if "minimum" in schema else "")


# --- in Python ---------------------------------------------------------------------------------


def _is(value: object, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "string": isinstance(value, str), "boolean": isinstance(value, bool), "integer": isinstance(value, int) and not isinstance(value, bool), "number": number,
        "array": isinstance(value, list), "object": isinstance(value, dict), "null": value is None,
    }[kind]


def fault_of(schema: dict, value: object, where: str = "$") -> str | None:
    """The first fault of a value, as ``PATH: reason``."""
    if "anyOf" in schema:
        return None if value is None else fault_of(schema["anyOf"][0], value, where)
    allowed = schema.get("enum", [schema["const"]] if "const" in schema else None)
    if allowed is not None:
        return None if any(type(a) is type(value) and a == value for a in allowed) else f"{where}: {_expected(schema)} is expected"
    if not _is(value, schema["type"]) or ("minimum" in schema and value < schema["minimum"]):
        return f"{where}: {_expected(schema)} is expected"
    if schema["type"] == "object" and "properties" in schema:
        for name in schema["required"]:
            if name not in value:
                return f"{where}.{name}: missing"
        for name, inner in schema["properties"].items():
            if name in value and (found := fault_of(inner, value[name], f"{where}.{name}")):
                return found
        if schema["additionalProperties"] is False and (unknown := sorted(set(value) - set(schema["properties"]))):
            return f"{where}.{unknown[0]}: unknown"
    if schema["type"] == "array":
        for k, item in enumerate(value):
            if found := fault_of(schema["items"], item, f"{where}[{k}]"):
                return found
    return None


def record_fault(record: object) -> str | None:
    """The first fault of a parsed line."""
    kind = record.get("kind") if isinstance(record, dict) else None
    return fault_of(SCHEMAS[kind], record) if isinstance(kind, str) and kind in SCHEMAS else f"$.kind: one of {', '.join(SCHEMAS)} is expected"


# --- as expressions ----------------------------------------------------------------------------

_KINDS = {"string": r"\ASTRING", "boolean": r"\ABOOLEAN", "integer": r"\ABIGINT", "number": r"\A(BIGINT|DECIMAL|DOUBLE|FLOAT)", "array": r"\AARRAY", "object": r"\AOBJECT", "null": r"\AVOID"}


def _first(faults: list[Column]) -> Column:
    return F.coalesce(*faults) if faults else F.lit(None).cast("string")


def first_fault(schema: dict, value: Column, where: Column) -> Column:
    """``fault_of`` as an expression over a variant column."""
    kind = F.schema_of_variant(value)
    if "anyOf" in schema:
        return F.when(~kind.rlike(_KINDS["null"]), first_fault(schema["anyOf"][0], value, where))
    wrong = F.concat(where, F.lit(f": {_expected(schema)} is expected"))
    allowed = schema.get("enum", [schema["const"]] if "const" in schema else None)
    if allowed is not None:
        is_text = isinstance(allowed[0], str)
        held = F.try_variant_get(value, "$", "string" if is_text else "bigint")
        return F.when(~F.coalesce(kind.rlike(_KINDS["string" if is_text else "integer"]) & held.isin(*allowed), F.lit(False)), wrong)
    bad = ~kind.rlike(_KINDS[schema["type"]])
    if "minimum" in schema:
        bad = bad | F.coalesce(F.try_variant_get(value, "$", "bigint") < schema["minimum"], F.lit(False))
    faults = [F.when(bad, wrong)]
    if schema["type"] == "object" and "properties" in schema:
        children = {name: F.try_variant_get(value, f"$.{name}" if name.replace("_", "").isalnum() else f"$['{name}']", "variant") for name in schema["properties"]}
        faults += [F.when(children[name].isNull(), F.concat(where, F.lit(f".{name}: missing"))) for name in schema["required"]]
        faults += [F.when(children[name].isNotNull(), first_fault(inner, children[name], F.concat(where, F.lit(f".{name}")))) for name, inner in schema["properties"].items()]
        if schema["additionalProperties"] is False:
            keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
            unknown = F.get(F.array_sort(F.array_except(keys, F.array(*map(F.lit, schema["properties"])).cast("array<string>"))), F.lit(0))
            faults.append(F.concat(where, F.lit("."), unknown, F.lit(": unknown")))
    if schema["type"] == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        each = F.transform(items, lambda x, k: first_fault(schema["items"], x, F.concat(where, F.lit("["), k.cast("string"), F.lit("]"))))
        faults.append(F.get(F.filter(each, lambda f: f.isNotNull()), F.lit(0)))
    return _first(faults)


def export_faults(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, fault) of the lines of an export that are not what they should be; blank lines are passed over."""
    rows = numbered_lines(spark, path).where(F.trim("line") != "").withColumn("v", F.try_parse_json("line"))
    kind = F.when(F.schema_of_variant(F.col("v")).startswith("OBJECT"), F.try_variant_get("v", "$.kind", "string"))
    known = [F.when(kind == name, F.struct(first_fault(schema, F.col("v"), F.lit("$")).alias("fault"))) for name, schema in SCHEMAS.items()]
    none = F.struct(F.lit(f"$.kind: one of {', '.join(SCHEMAS)} is expected").alias("fault"))
    told = F.when(F.col("v").isNull(), F.struct(F.lit("no record").alias("fault"))).otherwise(reduce(lambda a, b: F.coalesce(a, b), [*known, none]))
    return rows.select("path", "pos", told["fault"].alias("fault")).where("fault is not null")
