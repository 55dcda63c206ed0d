"""A counterfactual-regularised toxicity classifier.

A logistic regression over the presence of words, of beginnings of words and of repeated words. Training
adds a penalty on the difference between the scores of a labelled text and of its counterfactual twins, so
that the name of a group of people cannot carry a score by itself. Twins swap identity terms (``GROUPS``) only:

* a text that holds such terms is compared with the text in which each is swapped for another of its kind;
* every text is also compared with itself plus a mention, one term by the template ``TEXT TERM``; which
  term, a hash of the text decides. So terms that few or no training rows hold are regularised too.

Twins have no label and take part in the penalty only. Terms are features of the model whatever their
association with the label, so that the penalty has weights to act on. Without terms in the corpus, their
weights stay at zero and the model is that of the plain regression.

Training uses a bounded sample: at most ``max_rows`` labelled documents outside the held-out part, in
the order of a hash of their id, each with all its features; where rows repeat an id, the one whose text has
the least hash. Features are counted where the rows are; the driver gets at most ``max_features`` chosen ones
and the terms, and their places in the sampled rows, and what is broadcast is one weight for each of them.
Scoring is one pass over whole texts without a shuffle; each task hashes a word once.

Defined results: a null or empty text has no features and gets the score of the intercept; a null
``doc_id`` is not held out and has no label; labels that are null or belong to no document are
ignored, and repeated labels of one document count as toxic if any is; without labels of both kinds
every score is the smoothed share of toxic labels; repeated rows score alike; other columns are never
read. Labels, ``lang``, ``source`` and ``doc_id`` are no inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gritsieve.llm.arrow import raw, spare, table
from gritsieve.llm.decontaminate import FOLD
from gritsieve.llm.words import Memo
from gritsieve.scratch import Scratch

#: Terms for groups of people, each list of one kind (fixed values).
GROUPS = (
    ("men", "women", "boys", "girls", "males", "females"),
    ("man", "woman", "boy", "girl", "male", "female"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrant", "refugee", "foreigner", "native", "citizen"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("young", "old", "elderly", "disabled", "blind", "deaf"),
    ("homme", "femme"), ("hommes", "femmes"), ("mann", "frau"), ("hombre", "mujer"), ("hombres", "mujeres"),
)
#: The next term of its kind for every term.
SWAP = {term.encode(): kind[(k + 1) % len(kind)].encode() for kind in GROUPS for k, term in enumerate(kind)}
TERMS = tuple(SWAP)


@dataclass(frozen=True)
class ToxicityOptions:
    held_out: int = 2
    parts: int = 4
    threshold: float = 0.3
    #: Bound of the training sample: documents.
    max_rows: int = 20_000
    buckets: int = 1 << 20
    max_features: int = 4096
    min_rows: int = 5
    min_z: float = 5.0
    l2: float = 5e-5
    counterfactual: float = 10.0
    #: How much a missed toxic row costs against a wrongly flagged one.
    positive_weight: float = 3.0
    steps: int = 400
    rate: float = 0.5


def part_of(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


#: Beside whole words, their beginnings of so many bytes are features: inflected forms share them.
BEGINNINGS = (4, 5, 6, 7, 8)


def features(words: list[bytes], buckets: int) -> np.ndarray:
    """The sorted numbers of a text's words, of their beginnings, and of words that it holds twice or more."""
    counts = Counter(words)
    found = {*counts, *(b"=" + w for w, n in counts.items() if n > 1), *(b"^" + w[:n] for w in counts for n in BEGINNINGS if len(w) > n)}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in found), dtype=np.int64, count=len(found)))


def numbers_of(word: bytes, repeated: bool, buckets: int) -> list[int]:
    """The numbers of the features that one word brings into a text."""
    held = [word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) > n), *([b"=" + word] if repeated else [])]
    return [xxhash.xxh64_intdigest(w) % buckets for w in held]


def twins_of(words: list[bytes]) -> list[list[bytes]]:
    """The counterfactual twins of a text: with its terms swapped, if it has any, and with a term put in."""
    swapped = [[SWAP.get(w, w) for w in words]] if not SWAP.keys().isdisjoint(words) else []
    term = TERMS[xxhash.xxh64_intdigest(b" ".join(words)) % len(TERMS)]
    return [*swapped, [*words, term]]


@dataclass(frozen=True)
class Model:
    """Sorted feature numbers, their weights, and the intercept."""

    numbers: np.ndarray
    weights: np.ndarray
    intercept: float
    buckets: int
    #: Twins that training compared.
    pairs: int = 0

    def scorer(self) -> Callable[[bytes | None], float]:
        """A function from texts to scores that remembers which weights a word brings, up to a bound of words."""
        column = {int(n): k for k, n in enumerate(self.numbers)}

        def columns(repeated: bool) -> Memo:
            return Memo(lambda w: tuple({column[n] for n in numbers_of(w, repeated, self.buckets) if n in column}))

        once, again = columns(False), columns(True)

        def score(text: bytes | None) -> float:
            found: set[int] = set()
            for word, n in Counter((text or b"").translate(FOLD).split()).items():
                if held := (once if n == 1 else again)[word]:
                    found.update(held)
            logit = self.intercept + float(self.weights[sorted(found)].sum())
            return float(1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40))))

        return score


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every feature, for sparse products."""
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.empty(0, dtype=np.int64), *lists])


def fit(samples: list[np.ndarray], twins: list[list[np.ndarray]], labels: np.ndarray, numbers: np.ndarray, options: ToxicityOptions) -> Model:
    """Logistic regression by Adam over all rows of column numbers; the penalty is on differences of logits to each twin."""
    n, positive, k = len(labels), float(labels.sum()), len(numbers)
    cost = np.where(labels > 0, options.positive_weight, 1.0)
    cost /= cost.sum() or 1.0
    w, b = np.zeros(k), float(np.log((positive + 0.5) / (n - positive + 0.5)))
    if not k:
        return Model(numbers, w, b, options.buckets)
    rows, cols = _flat(samples)
    pairs = [(s, t) for s, ts in zip(samples, twins) for t in ts]
    here, there = _flat([s for s, _ in pairs]), _flat([t for _, t in pairs])
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, options.steps + 1):
        logits = b + np.bincount(rows, weights=w[cols], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - labels) * cost
        grad = np.bincount(cols, weights=error[rows], minlength=k) + options.l2 * w
        if pairs:
            apart = (np.bincount(here[0], weights=w[here[1]], minlength=len(pairs)) - np.bincount(there[0], weights=w[there[1]], minlength=len(pairs))) * 2 * options.counterfactual / len(pairs)
            grad += np.bincount(here[1], weights=apart[here[0]], minlength=k) - np.bincount(there[1], weights=apart[there[0]], minlength=k)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
        rate = options.rate * min(1.0, 2 * (1 - step / (options.steps + 1)))
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b = b - rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return Model(numbers, w, float(b), options.buckets, len(pairs))


def _sample(docs: DataFrame, labels: DataFrame, options: ToxicityOptions) -> DataFrame:
    """(doc_id, toxic, text) of the bounded sample."""
    of, toxic = spare(["doc_id", "text"], "id", "toxic")
    label = labels.select(labels["doc_id"].cast("long").alias(of), labels["toxic"].cast("int").alias(toxic)).where(F.col(of).isNotNull() & F.col(toxic).isNotNull())
    label = label.where(part_of(F.col(of), options.parts) != options.held_out).groupBy(of).agg(F.max(toxic).alias(toxic))
    chosen = label.orderBy(F.xxhash64(of), of).limit(options.max_rows)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = slim.join(F.broadcast(chosen), slim["doc_id"] == chosen[of])  # bounded by max_rows
    return rows.groupBy("doc_id").agg(F.first(toxic).alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def _featured(rows: DataFrame, options: ToxicityOptions) -> DataFrame:
    """(doc_id, toxic, here, twins): features of the rows and of their counterfactual twins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or b"").translate(FOLD).split() for t in raw(batch, "text")]
            yield table({
                "doc_id": (batch.column("doc_id"), pa.int64()), "toxic": (batch.column("toxic"), pa.int32()),
                "here": ([features(w, options.buckets) for w in words], pa.list_(pa.int32())),
                "twins": ([[features(t, options.buckets) for t in twins_of(w)] for w in words], pa.list_(pa.list_(pa.int32()))),
            })

    return rows.mapInArrow(run, "doc_id long, toxic int, here array<int>, twins array<array<int>>")


def train(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions()) -> Model:
    """Fit on the bounded sample of labelled documents outside the held-out part.

    Features are counted and chosen by their association with the label where the rows are; the
    driver gets the chosen ones, and which of them each sampled row has.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    sample = scratch.stash(_sample(docs, labels, options), "sample")
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    if not 0 < positive < n:
        return fit([np.empty(0, dtype=np.int64)] * n, [[]] * n, np.full(n, float(positive > 0)), np.empty(0, dtype=np.int64), options)
    share = positive / n
    rows = scratch.stash(_featured(sample, options), "features")
    counts = rows.select(F.explode("here").alias("f"), (F.col("toxic") > 0).cast("long").alias("t")).groupBy("f").agg(F.count("*").alias("c"), F.sum("t").alias("t")).where(F.col("c") >= options.min_rows)
    z = F.abs(F.col("t") - F.col("c") * share) / F.sqrt(F.col("c") * share * (1 - share))
    best = counts.withColumn("z", z).where(F.col("z") >= options.min_z).orderBy(F.desc("z"), "f").limit(options.max_features).select("f").toArrow()
    terms = [xxhash.xxh64_intdigest(w) % options.buckets for w in TERMS]
    numbers = np.unique(np.concatenate([best.column("f").to_numpy().astype(np.int64), np.array(terms, dtype=np.int64)]))
    shared = spark.sparkContext.broadcast(numbers)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(features: list[int]) -> np.ndarray:
            return np.flatnonzero(np.isin(shared.value, features))

        for batch in batches:
            yield table({
                "doc_id": (batch.column("doc_id"), pa.int64()), "toxic": (batch.column("toxic"), pa.int32()),
                "here": ([columns(x.values.to_numpy()) for x in batch.column("here")], pa.list_(pa.int32())),
                "twins": ([[columns(t) for t in x] for x in batch.column("twins").to_pylist()], pa.list_(pa.list_(pa.int32()))),
            })

    found = rows.mapInArrow(chosen, "doc_id long, toxic int, here array<int>, twins array<array<int>>").toArrow().sort_by([("doc_id", "ascending")])
    scratch.drop("sample", "features")
    array = lambda x: np.array(x, dtype=np.int64)
    here, twins = map(array, found.column("here").to_pylist()), ([array(t) for t in x] for x in found.column("twins").to_pylist())
    return fit(list(here), list(twins), (found.column("toxic").to_numpy() > 0).astype(float), numbers, options)


REPORT_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def toxicity_report(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions()) -> DataFrame:
    """For each document: whether it was held out, its score and the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, options))
    held = F.coalesce(part_of(docs["doc_id"].cast("long"), options.parts) == options.held_out, F.lit(False))
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held.alias("held_out"), docs["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            scores = [score(t) for t in raw(batch, "text")]
            yield table({
                "doc_id": (batch.column("doc_id"), pa.int64()), "held_out": (batch.column("held_out"), pa.bool_()),
                "score": (scores, pa.float64()), "predicted": ([int(s >= options.threshold) for s in scores], pa.int32()),
            })

    return slim.mapInArrow(run, REPORT_SCHEMA)
