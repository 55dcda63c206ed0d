"""The pipeline's stages against the operators' own reports, and as a whole against brute force."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from gritsieve.llm import decontaminate as dc, line_dedup as ld, mixing, quality, simhash
from tests.llm.test_operators import brute_copies, brute_fingerprint, brute_lines, brute_quality, lower

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_dedup", "decontamination", "mixing"]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            assert ids(out) == ids(quality.quality_report(docs).where("kept"))
        elif name == "line_dedup":
            assert ids(out) == ids(docs)
            assert ld.line_dedup_report(docs).agg({"n_dropped": "sum"}).first()[0] > 0
        elif name == "simhash_dedup":
            assert ids(out) == ids(simhash.simhash_report(docs).where("doc_id = component_id"))
        elif name == "decontamination":
            assert ids(out) == ids(dc.contamination_report(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("not contaminated"))
        else:
            assert out.count() == mixing.mix_report(docs).agg({"copies": "sum"}).first()[0]
        assert k == len(names) - 1 or out.columns == columns
        docs = out
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["copy_no"], r["text"]) for r in whole.collect()) == sorted((r["doc_id"], r["copy_no"], r["text"]) for r in docs.collect())


def brute_pipeline(documents, items):
    """(doc_id, text, copy_no) of the whole pipeline, stage by stage in plain Python; how many rows each stage kept."""
    rows = [r for r in documents if brute_quality(r[1])]
    kept = [len(rows)]
    rows = [(r[0], text, *r[2:]) for r, (_, _, _, text) in zip(rows, brute_lines(rows, 10))]
    prints, group = [brute_fingerprint(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = group[a], group[b]
                group = [x if g == y else g for g in group]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    rows = list({group[k]: rows[k] for k in reversed(order)}.values())
    kept.append(len(rows))
    fold = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    windows = {tuple(w[k : k + 13]) for w in map(fold, items) if w for k in range(max(1, len(w) - 12))}

    def clean(text):
        w = fold(text)
        hit = {k + d for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for d in range(n)}
        return not hit or 20 * len(hit) < len(w)

    rows = [r for r in rows if clean(r[1])]
    kept.append(len(rows))
    return Counter((r[0], r[1], c) for r, n in zip(rows, brute_copies(rows)) for c in range(1, n + 1)), kept


@pytest.fixture(scope="session")
def tables(spark, documents, docs, empty, tmp_path_factory):
    """Folders of the tables: rows with nulls, copies, ties and clashing columns, and empty ones."""
    root = tmp_path_factory.mktemp("tables")
    long = sorted((r for r in documents if r[1] and brute_quality(r[1])), key=lambda r: r[0] or 0)
    items = [" ".join(long[1][1].split()[2:40]), long[2][1].upper(), None, "...", "", "never seen " * 8]
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(None, items[0])], "item_id long, text string")
    for name, rows, test in (("full", docs, benchmark), ("empty", empty, benchmark), ("none", docs, benchmark.limit(0))):
        rows.write.parquet(f"{root}/{name}/documents.parquet")
        test.write.parquet(f"{root}/{name}/benchmark.parquet")
    return root, items


def test_whole_pipeline_against_brute_force(spark, documents, docs, tables):
    root, items = tables
    for name, tests in (("full", items), ("none", [])):
        want, kept = brute_pipeline(documents, tests)
        out = corpus_pipeline.run(spark, f"{root}/{name}")
        assert out.columns == [*docs.columns, "copy_no"]
        assert Counter((r["doc_id"], r["text"], r["copy_no"]) for r in out.select("doc_id", "text", "copy_no").collect()) == want
        assert len(documents) > kept[0] > kept[1] >= kept[2] > 0 and (kept[1] > kept[2]) == bool(tests)


def test_stages_on_rows_of_every_kind(spark, docs, empty, tables):
    """Every stage on unfiltered rows with nulls, empty and long texts, ties and clashing columns, and on none."""
    root, _ = tables
    for name, stage in corpus_pipeline.STAGES:
        columns = lambda df: df.columns + ["copy_no"] * (name == "mixing")  # noqa: B023, E731
        out, nothing = stage(spark, docs, f"{root}/full"), stage(spark, empty, f"{root}/empty")
        assert out.columns == columns(docs) and nothing.columns == columns(empty)
        assert out.count() > 0 and nothing.count() == 0
        assert out.select("row", "kept", "copy").distinct().collect() == [("x", "x", "x")]
    assert corpus_pipeline.run(spark, f"{root}/empty").count() == 0
