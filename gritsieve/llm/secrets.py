"""Secret scans through a trigram inverted index, in DataFrame functions only.

For each rule the trigrams that any match must hold are derived from the regular expression as a
Boolean query. The index has a posting (trigram, document) for every trigram that some rule asks for;
postings are intersected by document, the queries are evaluated, and only candidate documents are
verified with the rule's expression. A rule without mandatory trigrams scans every document.

The index folds case, which may add candidates and loses none. Postings are combined by document, so
a frequent trigram makes no large group; texts are dealt once, to meet their candidate rules.

Defined results: a null text counts as an empty one; a null ``doc_id`` stays null and its rows are
told apart by their text; repeated rows each give their own result; an empty table gives an empty
result; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gritsieve.scratch import Scratch


@dataclass(frozen=True)
class SecretRule:
    """A kind of secret. ``least``: matches whose ``group`` is shorter are dropped after matching.

    ``bounded`` may give an expression that finds just the matches that are not dropped. It must find
    the same ones: a run of one class that is too short holds no long enough run, so a lower bound on
    the run says the same as dropping it, and spares a mark at every short run of a text.
    """

    kind: str
    pattern: str
    fold: bool = False
    group: int = 0
    least: int = 0
    bounded: str = ""

    @property
    def java(self) -> str:
        return ("(?i)" if self.fold else "") + (self.bounded or self.pattern)


#: The base rules, in the order of their kinds, then the rules that this method adds (fixed values).
BASE_RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", False, 0, 20, r"AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", r"[0-9a-f]+", False, 0, 24, r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES

# --- trigram queries ---------------------------------------------------------------------------

#: At most so many literal strings are followed at once; a wider choice ends the run of literals.
MAX_STRINGS = 8

Query = tuple  # ("all",) matches everything; ("tri", t); ("and", q...); ("or", q...)
ALL: Query = ("all",)


def _and(parts: Iterable[Query]) -> Query:
    flat = {q: None for p in parts for q in (p[1:] if p[0] == "and" else (p,)) if q != ALL}
    return ALL if not flat else next(iter(flat)) if len(flat) == 1 else ("and", *flat)


def _or(parts: Iterable[Query]) -> Query:
    flat = {q: None for p in parts for q in (p[1:] if p[0] == "or" else (p,))}
    return ALL if ALL in flat or not flat else next(iter(flat)) if len(flat) == 1 else ("or", *flat)


def _of_strings(strings: Iterable[str]) -> Query:
    return _or(_and(("tri", s[k : k + 3]) for k in range(len(s) - 2)) for s in sorted(strings))


def _class_strings(items: Sequence) -> set[str] | None:
    """The characters of a small class, or None."""
    chars: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            chars.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < MAX_STRINGS:
            chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return chars if len(chars) <= MAX_STRINGS else None


def _exact(node) -> set[str] | None:
    """All strings that a part of a pattern matches, if they are few."""
    kind, value = node
    if kind is sre.LITERAL:
        return {chr(value).lower()}
    if kind is sre.IN:
        return _class_strings(value)
    if kind is sre.SUBPATTERN:
        return _exact_sequence(value[3])
    if kind is sre.BRANCH:
        found = [_exact_sequence(branch) for branch in value[1]]
        union = set().union(*[f for f in found if f is not None])
        return None if None in found or len(union) > MAX_STRINGS else union
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, body = value
        inner = _exact_sequence(body)
        if inner is None or high is sre.MAXREPEAT or high > 8:
            return None
        strings: set[str] = set()
        for n in range(low, high + 1):
            run = {""}
            for _ in range(n):
                run = {a + b for a in run for b in inner}
                if len(run) > MAX_STRINGS:
                    return None
            strings |= run
        return strings if len(strings) <= MAX_STRINGS else None
    if kind is sre.AT:
        return {""}
    return None


def _exact_sequence(nodes) -> set[str] | None:
    strings = {""}
    for node in nodes:
        found = _exact(node)
        if found is None:
            return None
        strings = {a + b for a in strings for b in found}
        if len(strings) > MAX_STRINGS:
            return None
    return strings


def _query(nodes) -> Query:
    parts: list[Query] = []
    run = {""}
    for node in nodes:
        found = _exact(node)
        if found is not None and len(joined := {a + b for a in run for b in found}) <= MAX_STRINGS:
            run = joined
            continue
        parts.append(_of_strings(run))
        run = found if found is not None else {""}
        if found is None:
            kind, value = node
            if kind is sre.SUBPATTERN:
                parts.append(_query(value[3]))
            elif kind is sre.BRANCH:
                parts.append(_or(_query(branch) for branch in value[1]))
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
                parts.append(_query(value[2]))
    parts.append(_of_strings(run))
    return _and(parts)


def trigram_query(pattern: str) -> Query:
    """The Boolean query over folded trigrams that every text with a match satisfies."""
    return _query(sre_parse.parse(pattern))


def trigrams(query: Query) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*[trigrams(q) for q in query[1:]]) if query[0] in ("and", "or") else set()


# --- the index ---------------------------------------------------------------------------------

WORD_BITS = 62


def postings(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """(doc_id, row, gram): one posting for each document and each indexed trigram that it holds."""
    held = F.explode(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams)]))
    return docs.select("doc_id", "row", F.lower("text").alias("low")).select("doc_id", "row", held.alias("gram")).where("gram is not null")


def _evaluate(query: Query, grams: Sequence[str]) -> Column:
    if query[0] == "tri":
        k = grams.index(query[1])
        return F.col(f"m{k // WORD_BITS}").bitwiseAND(F.lit(1 << k % WORD_BITS).cast("long")) != 0
    out = None
    for part in query[1:]:
        value = _evaluate(part, grams)
        out = value if out is None else out & value if query[0] == "and" else out | value
    return out


def candidates(index: DataFrame, rules: Sequence[SecretRule], queries: Sequence[Query], grams: Sequence[str]) -> DataFrame:
    """(doc_id, row, rules): the numbers of the rules whose query the document's postings satisfy."""
    words = range(-(-len(grams) // WORD_BITS))
    bit = [F.when((F.col("gram") >= w * WORD_BITS) & (F.col("gram") < (w + 1) * WORD_BITS), F.expr(f"shiftleft(1L, cast(gram as int) - {w * WORD_BITS})")).otherwise(F.lit(0).cast("long")) for w in words]
    masks = index.groupBy("doc_id", "row").agg(*[F.bit_or(b).alias(f"m{w}") for w, b in zip(words, bit)])
    met = F.array(*[F.when(_evaluate(q, grams), F.lit(k)) for k, (_, q) in enumerate(zip(rules, queries)) if q != ALL])
    return masks.select("doc_id", "row", F.filter(met, lambda k: k.isNotNull()).alias("rules")).where(F.size("rules") > 0)


# --- verification ------------------------------------------------------------------------------

#: Marks the ends of matches. Both are private-use characters that no rule matches, so exchanging one
#: for the other in a text changes neither matches nor lengths and makes the first free for use.
MARK, OTHER = "\ue000", "\ue001"
#: Parts of a marked text that are folded at once: spans are appended to short arrays only.
FOLD = 256


SPANS = "array<struct<start:bigint,ord:int,kind:string,stop:bigint>>"


def marked_parts(text: Column, rule: SecretRule) -> Column:
    """The text (free of marks) cut at the ends of the rule's leftmost matches that do not overlap."""
    return F.split(F.regexp_replace(text, F.lit(rule.java), F.lit(f"{MARK}$0{MARK}")), MARK)


def part_spans(parts: Column, rule: SecretRule, order: int) -> Column:
    """An array of (start, order, kind, stop) of the matches among the parts: every second one."""
    kind = f"struct<pos:bigint,i:int,out:{SPANS}>"
    empty = F.array().cast(SPANS)

    def step(acc: Column, part: Column) -> Column:
        size = F.length(part).cast("long")
        judged = F.length(F.regexp_extract(part, rule.java, rule.group)) if rule.group else size
        span = F.struct(acc["pos"].alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (acc["pos"] + size).alias("stop"))
        good = (acc["i"] % 2 == 1) & (judged >= rule.least)
        return F.struct((acc["pos"] + size).alias("pos"), (acc["i"] + 1).alias("i"), F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out")).cast(kind)

    def block(acc: Column, at: Column) -> Column:
        """Fold one block of parts from the place where the last ended, then append its spans."""
        start = F.struct(acc["pos"].alias("pos"), acc["i"].alias("i"), empty.alias("out")).cast(kind)
        return F.aggregate(F.slice(parts, at, FOLD), start, step, lambda done: F.struct(done["pos"].alias("pos"), done["i"].alias("i"), F.concat(acc["out"], done["out"]).alias("out")).cast(kind))

    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).alias("i"), empty.alias("out")).cast(kind)
    small = F.aggregate(parts, zero, step, lambda done: done["out"])
    large = F.aggregate(F.sequence(F.lit(1), F.size(parts), F.lit(FOLD)), zero, block, lambda done: done["out"])
    return F.when(F.coalesce(F.size(parts), F.lit(0)) <= 1, empty).when(F.size(parts) <= 2 * FOLD, small).otherwise(large)


def find_secrets(docs: DataFrame, rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """(doc_id, found): the array of all spans (start, ord, kind, stop), by start and rule."""
    scratch = Scratch(docs.sparkSession, "secrets")
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    queries = [trigram_query(rule.pattern) for rule in rules]
    grams = sorted(set().union(*map(trigrams, queries)))
    if grams:
        index = scratch.stash(postings(slim, grams).sortWithinPartitions("gram"), "postings")
        met = scratch.stash(candidates(index, rules, queries, grams), "candidates")
        scratch.drop("postings")
        met = met.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "rules")
        slim = slim.join(met, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row")), "left")
    else:
        slim = slim.withColumn("rules", F.lit(None).cast("array<int>"))
    # one projection after the other: each is used several times by the next and computed once
    freed = slim.select("doc_id", "rules", F.replace("text", F.lit(MARK), F.lit(OTHER)).alias("text"))
    wanted = [F.lit(True) if q == ALL else F.coalesce(F.array_contains("rules", F.lit(k)), F.lit(False)) for k, q in enumerate(queries)]
    parts = freed.select("doc_id", *[F.when(w, marked_parts(F.col("text"), r)).alias(f"p{k}") for k, (w, r) in enumerate(zip(wanted, rules))])
    spans = parts.select("doc_id", *[part_spans(F.col(f"p{k}"), r, k).alias(f"s{k}") for k, r in enumerate(rules)])
    return spans.select("doc_id", F.array_sort(F.concat(*[F.col(f"s{k}") for k in range(len(rules))])).alias("found"))


def secrets_report(docs: DataFrame, rules: Sequence[SecretRule] = RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """Counts and spans as text; the first ``base`` rules are the base spans."""
    told = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    found = find_secrets(docs, rules).withColumn("base", F.filter("found", lambda x: x["ord"] < base))

    def count(order: int) -> Column:
        return F.size(F.filter("base", lambda x: x["ord"] == order)).cast("long").alias(f"n_{rules[order].kind}")

    counts = [count(k) for k in range(base)]
    return found.select("doc_id", *counts, F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
