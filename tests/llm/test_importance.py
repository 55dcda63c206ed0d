"""CRC algebra against zlib, and the draw against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gritsieve.llm import importance as imp
from tests.llm.conftest import SCHEMA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, grams):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[k : k + n]) for n in range(1, grams + 1) for k in range(len(words) - n + 1)]


@pytest.mark.parametrize("grams", [1, 2, 5])
def test_crcs_of_runs_are_those_of_their_strings(grams):
    rng = random.Random(grams)
    of = imp.Grams(grams, 10_000)
    for n in (0, 1, 2, 4, 5, 300):
        text = " ".join("".join(rng.choice("abZ9é") for _ in range(rng.choice([1, 2, 7, 2000]))) for _ in range(n))
        n_words, found = of.of(text.encode())
        words, want = features(text, grams)
        assert n_words == len(words) and found.tolist() == [zlib.crc32(f.encode()) % 10_000 for f in want]


@pytest.mark.parametrize("length", [0, 1, 2, 3, 255, 4096, 1_000_003])
def test_shift_matrix(length):
    matrix = imp._bytewise(imp.shift_matrix(length))
    left, right = b"some words", bytes(length)
    c = zlib.crc32(left)
    moved = matrix[0][c & 255] ^ matrix[1][c >> 8 & 255] ^ matrix[2][c >> 16 & 255] ^ matrix[3][c >> 24]
    assert int(moved) ^ zlib.crc32(right) == zlib.crc32(left + right)


def brute(rows, target, grams, buckets, min_words, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own, wanted = (Counter(bucket(f) for t in texts for f in features(t, grams)[1]) for texts in ([r[1] for r in rows], target))
    big_s, big_t = sum(own.values()), sum(wanted.values())
    found = []
    for d, text, *_ in rows:
        words, held = features(text, grams)
        gains = [math.floor(1000 * math.log((wanted[b] + 1) * (big_s + buckets) / ((own[b] + 1) * (big_t + buckets)))) for b in map(bucket, held)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        found.append([d, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((f for f in found if f[5] >= min_words), key=lambda f: (-f[3], f[0] is None, f[0] or 0, f[1]))
    for k, f in enumerate(able[: percent * len(able) // 100], 1):
        f[4] = k
    return Counter(tuple(f[:5]) for f in found)


@pytest.mark.parametrize("grams, buckets, percent", [(1, 10_000, 10), (2, 97, 50), (3, 10_000, 100)])
def test_draw(spark, docs, documents, grams, buckets, percent):
    target = ["the benchmark asks for words", None, "", "of the and TO in 12 é " * 30]
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = imp.importance_report(docs, wanted, grams=grams, buckets=buckets, percent=percent)
    want = brute(documents, target, grams, buckets, 20, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and Counter(tuple(r) for r in got.collect()) == want
    drawn = imp.resample(docs, wanted, grams=grams, buckets=buckets, percent=percent)
    assert drawn.columns == docs.columns and {r["doc_id"] for r in drawn.select("doc_id").collect()} == {w[0] for w in want if w[4]}


def test_empty_tables(spark, docs, documents, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert imp.importance_report(empty, none).collect() == []
    assert Counter(tuple(r) for r in imp.importance_report(docs, none).collect()) == brute(documents, [], 1, 10_000, 20, 10)


def test_reruns_draw_alike_at_any_partitioning(spark, docs):
    wanted = spark.createDataFrame([(1, "the of and")], "item_id long, text string")
    once, again = (Counter(tuple(r) for r in imp.importance_report(docs.repartition(n), wanted).collect()) for n in (1, 7))
    assert once == again


def test_long_word_and_long_text(spark):
    rows = [(1, "x" * 3_000_000 + " y", "en", "s", 0), (2, "alpha beta " * 200_000, "en", "s", 0)]
    wanted = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    got = imp.importance_report(spark.createDataFrame(rows, SCHEMA), wanted, grams=2)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, ["alpha"], 2, 10_000, 20, 10)
    assert np.array_equal(imp.Grams(1, 10_000).of(rows[0][1].encode())[1], [zlib.crc32(b"x" * 3_000_000) % 10_000, zlib.crc32(b"y") % 10_000])
