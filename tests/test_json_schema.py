"""The schema of exports: Python and the compiled expression name the same first fault."""

import json
import random

import pytest

from gritsieve.operators.rules import Rule, with_rules
from gritsieve.plans import json_schema as js
from gritsieve.plans.engine import Engine
from gritsieve.plans.export import ExportError, read_export, write_run
from gritsieve.sources.config import ConfigError, load_config
from gritsieve.streaming.ledger import Ledger


@pytest.fixture
def lines(spark, project, tmp_path):
    out, engine = str(tmp_path / "out.jsonl"), Engine(spark)
    write_run(out, engine.run(engine.clone(project.path), "r", "clone", ledger=Ledger(spark, str(tmp_path / "l"))))
    return [json.loads(x) for x in open(out)]


def places(value, path=()):
    """Every place of a record."""
    yield path
    for key, inner in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from places(inner, (*path, key))


def spoiled(record, rng):
    """A copy with one place changed, dropped or added."""
    record = json.loads(json.dumps(record))
    *above, last = rng.choice([p for p in places(record) if p])
    held = record
    for key in above:
        held = held[key]
    how = rng.randrange(3)
    if how == 0:
        del held[last]
    elif how == 1 and isinstance(held, dict):
        held["stranger"] = 1
    else:
        held[last] = rng.choice([None, -1, 1.5, "x", True, [], {}, [None], {"a": 1}])
    return record


def test_faults_agree(spark, lines, tmp_path):
    rng, path = random.Random(4), tmp_path / "bad.jsonl"
    records = [*lines, *[spoiled(rng.choice(lines), rng) for _ in range(150)], [], 7, {"kind": None}, {"kind": "what"}]
    path.write_text("\n".join([*map(json.dumps, records), "", "{no json"]) + "\n")
    want = {k: f for k, f in enumerate(map(js.record_fault, records)) if f} | {len(records) + 1: "no record"}
    assert not set(range(len(lines))) & set(want) and len(want) > 80 and any("[" in f for f in want.values())
    got = {r["pos"]: r["fault"] for r in js.export_faults(spark, str(path)).collect()}
    assert got == want


def test_a_broken_export_names_line_and_field(lines, tmp_path):
    path = tmp_path / "x.jsonl"
    del lines[0]["source"]
    path.write_text("".join(json.dumps(x) + "\n" for x in lines))
    with pytest.raises(ExportError, match=r"line 1: \$\.source: missing"):
        read_export(str(path))


def test_schema_is_json_schema(capsys):
    from gritsieve.cli import main

    assert main(["schema"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["$schema"].startswith("https://json-schema.org/") and {s["properties"]["kind"]["const"] for s in told["oneOf"]} == {"batch", "run", "candidate"}


def test_custom_rules_are_strict(tmp_path):
    with pytest.raises(ValueError, match="taken"):
        with_rules([Rule("docs-file", "docs", "name", ("*.x",), "why")], ["docs-file"])
    path = tmp_path / "gritsieve.toml"
    for given, fault in (("id = 7", "id: a text"), ('id = "x"\nrationale = 1', "rationale: a text"), ('id = "docs-file"', "taken")):
        more = "" if "rationale" in given else 'rationale = "why"\n'
        path.write_text(f'[[classify.rules]]\ncategory = "docs"\nnames = ["*.x"]\n{more}{given}\n')
        with pytest.raises(ConfigError, match=fault):
            load_config(str(path))
