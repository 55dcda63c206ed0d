"""The Jaccard join against all pairs of sets, with shared passages, near copies, nulls and ties."""

import random

import pytest

from gritsieve.llm import jaccard
from tests.llm.conftest import SCHEMA


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def first(ids):
    """The smallest id; a null one comes last."""
    return min(ids, key=lambda d: (d is None, d or 0))


def grouped(sets):
    """The number of each set's component, by comparing all pairs."""
    group = list(range(len(sets)))
    for a, x in enumerate(sets):
        for b in range(a):
            if group[a] != group[b] and alike(x, sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return group


def brute(rows):
    """(doc_id, size, component) of every row."""
    sets = [shingles(t) for _, t in rows]
    group = grouped(sets)
    return sorted(((d, len(sets[k]), first([rows[j][0] for j in range(len(rows)) if group[j] == group[k]])) for k, (d, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    passage, found = [rng.choice(words) for _ in range(60)], []
    for _ in range(20):
        base = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randint(1, 16)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.4:
                at = rng.randrange(len(text) + 1)
                text[at:at] = passage
            found.append((len(found) * 7 % 1009, " ".join(text)))
    found += [(2000 + k, " ".join(passage + [rng.choice(words) for _ in range(k % 14)])) for k in range(30)]
    found += [(3000, None), (3001, ""), (3002, " \n\x0b"), (3003, "one Two"), (3004, "One  two"), (None, "one two"), (None, "without an id, none of its group has one"), (3001, "x"), (3001, "x")]
    return found + [(3005, "é " * 300), (3006, "É " * 300), (3007, "long " + " ".join(rng.choice(words) for _ in range(30_000)))]


@pytest.mark.parametrize("options", [{}, {"heavy": 50, "heavy_rows": 3}, {"heavy": 0}])
def test_components(spark, rows, options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in jaccard.jaccard_report(docs, **options).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("limits", [{}, {"GROUP": 2, "GROUP_TOKENS": 50, "BLOCK": 100, "RANGE": 64}])
def test_links_of_all_pairs(spark, rows, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    ids = {}
    for d, text in rows:
        if shingles(text):
            ids.setdefault(shingles(text), []).append(d)
    heads = [(x, first(found)) for x, found in ids.items()]
    want = sorted((*sorted((a, b)), len(x & y)) for k, (x, a) in enumerate(heads) for y, b in heads[:k] if alike(x, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in jaccard.jaccard_links(docs).collect()) == want
    if limits:
        assert sorted((tuple(r) for r in jaccard.jaccard_report(docs).collect()), key=str) == brute(rows)


def test_one_of_each_component_stays(docs, documents, empty):
    kept = jaccard.dedup_similar(docs)
    assert kept.columns == docs.columns
    sets = [shingles(r[1]) for r in documents]
    assert len({g for g, x in zip(grouped(sets), sets) if x}) == kept.where("trim(text) rlike '[^ \\n\\t]'").count()
    assert jaccard.dedup_similar(empty).collect() == [] and jaccard.jaccard_report(empty).collect() == [] and jaccard.jaccard_links(empty).collect() == []


def test_group_of_near_copies_is_not_paired(spark):
    """A partition of many near copies is joined by its first; few pairs are left to look at."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for k in range(400):
        text = list(base)
        text[rng.randrange(300)] = f"own{k}"
        rows.append((k, " ".join(text), "en", "s", 0))
    scratch = jaccard.Scratch(spark, "pairs")
    _, _, links = jaccard._links(spark.createDataFrame(rows, SCHEMA), 5, 80, False, scratch, jaccard.HEAVY, jaccard.HEAVY_ROWS)
    assert links.count() < 4 * len(rows)
    assert spark.read.parquet(scratch.path("wanted")).count() < len(rows)
    assert {r["component_id"] for r in jaccard.jaccard_report(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}
