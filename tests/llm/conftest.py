import random

import pytest

WORDS = "the of and to in is that for it was on are as with they be at one have this from or had by hot but some what there we can out other were all your when up use".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "ed", "s", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def documents():
    """Rows with copies, near copies, shared lines, nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(11)
    lines = [prose(rng, 9) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [prose(rng, rng.randint(3, 20)) for _ in range(rng.randint(1, 6))]
        for line in lines[: rng.randint(0, 6)]:
            parts.insert(rng.randint(0, len(parts)), rng.choice(["", " ", "\t"]) + (line.upper() if rng.random() < 0.3 else line))
        rows.append((k, "\n".join(parts), "en", f"s{k % 4}", 0))
    copy = rows[5][1]
    rows += [(100 + k, copy, "en", "s1", 0) for k in range(12)]
    rows += [(200 + k, copy.replace("the", f"thé{k}", 1), "fr", None, 0) for k in range(8)]
    rows += [(300, None, None, None, None), (301, "", "en", "", 0), (302, "\n\n \n", "en", "s1", 0), (303, "É è\x1c ñ" * 5, "es", "s2", 0), (304, prose(rng, 30_000), "en", "s3", 0), (305, "ab " * 4000, "en", "s3", 0)]
    rows += [(None, "a text without id " * 20, "en", "s2", 0), (None, "another text without id " * 20, "en", "s2", 0), (5, copy, "en", "s1", 0), (306, "x", "en", "s1", 0), (306, "x y z " * 40, "en", "s1", 0)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, documents):
    """The rows, with extra columns whose names clash with those of the operators."""
    df = spark.createDataFrame(documents, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("row", "batch", "n_words", "kept", "fp", "h1", "size", "rules", "copy", "name", "doc")}).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
