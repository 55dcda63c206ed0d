"""The scan of Arrow buffers against plain counts, and the audit against running all orders of the filters."""

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from gritsieve.llm import audit
from tests.llm.conftest import SCHEMA


def counted(text):
    words = (text or "").encode().split()
    return len(words), len(set(words)), sum("A" <= c <= "Z" for c in text or ""), sum(c in "#$%&*|" for c in text or ""), len(text or "")


def scanned(column, window):
    scan = audit.Scan(*audit._buffer(column), window)
    return list(zip(*(x.tolist() for x in (scan.words, scan.distinct, scan.capitals, scan.symbols, scan.points))))


@pytest.mark.parametrize("window", [1, 7, 60, 1 << 20])
def test_scan(window):
    rng = random.Random(window)
    for _ in range(60):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("aA é\n#\x0b　bB  x") for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(rng.randint(0, 12))]
        cut = rng.randint(0, len(texts))
        for kind in (pa.string(), pa.large_string()):
            assert scanned(pa.array(texts, kind).slice(cut), window) == [counted(t) for t in texts[cut:]]


def test_equal_hashes_are_verified(monkeypatch):
    """With a multiplier of one the hash is a sum of bytes, so words of the same letters collide."""
    monkeypatch.setattr(audit, "BASE", 1)
    texts = ["ab ba ab abc cab x", "ad bc da cb ad", "aa b", ""]
    for window in (4, 1 << 20):
        assert scanned(pa.array(texts), window) == [counted(t) for t in texts]


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    found, failing = Counter(), []
    for d, text, lang, *_ in rows:
        n, distinct, capitals, symbols, points = counted(text)
        copy = any((o[1] or "") == (text or "") and o[0] is not None and (d is None or o[0] < d) for o in rows)
        fails = {f for f, bad in zip("ABCDE", (n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * points, symbols > 0, copy)) if bad}
        failing.append((d, lang or "", fails))
    out, removed_by = [], Counter()
    for part in {p for _, p, _ in failing}:
        held = [(d, f) for d, p, f in failing if p == part]
        for order in permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_by[part, f] += len(removed)
                fails = sum(f in x[1] for x in held)
                out.append((part, "".join(order), step, len(left), len(removed), fails - len(removed), sum(x[1] == {f} for x in held), sum(x[0] in good for x in removed), sum(x[0] in toxic for x in removed), f))
    for row in out:
        found[*row[:9], removed_by[row[0], row[9]]] += 1
    return found


def test_audit(spark, docs, documents, empty):
    labels = [(d, d % 2, d % 3 == 0 and 1 or 0) for d in range(0, 60, 2)] + [(100, 1, None), (101, None, 1), (5, 0, 0), (5, 1, 1), (None, 1, 1), (9999, 1, 1), (304, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(docs, table)
    assert Counter(tuple(r) for r in got.collect()) == brute(documents, labels)
    assert audit.filter_audit(empty, table).collect() == []
    assert Counter(tuple(r) for r in audit.filter_audit(docs, table.limit(0)).collect()) == brute(documents, [])


def test_long_text_is_scanned_in_windows(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "Beta", "gamma$"]) + str(rng.randrange(40_000)) for _ in range(400_000))
    assert scanned(pa.array(["x y", text, "z" * 2_500_000 + " z"]), audit.WINDOW) == [counted(t) for t in ("x y", text, "z" * 2_500_000 + " z")]
    row = audit.filter_flags(spark.createDataFrame([(1, text, None, "s", 0)], SCHEMA)).first()
    assert row["lang"] == "" and row["failed"] == 2 + 8


def test_steps_cover_every_mask():
    steps = audit._steps()
    assert len(steps) == 32 * 120 * 5 and all(s[3] + s[4] <= 1 for s in steps)
    assert np.sum([s[4] for s in steps if s[0] == 1]) == 120  # who fails one filter only is removed once in each order
