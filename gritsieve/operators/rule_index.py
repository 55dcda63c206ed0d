"""Classification by an index of the rules, for tables of thousands of rules.

Every pattern gets a key that each path it matches must have: a whole file name, an extension, the first letters of
the name, a directory or a signal. Files are joined with the patterns of their keys, the candidates are verified with the
pattern itself, and the first rule in order wins. Patterns without such a key stay in the CASE of ``rules``,
which is all that grows with them. Equal (path, signals) pairs are classified once.

The results are those of ``classify``, for null paths (the fallback) and absent signals too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, functions as F

from gritsieve.functions.globs import component_regex, expand_braces, flags, path_regex
from gritsieve.functions.text import file_name, language_of, layout_dirs, normal_path
from gritsieve.operators.rules import FALLBACK, RULES, Rule, classification

#: Letters of a name that make a key.
HEAD = 3
_WILD = re.compile(r"[*?\[\]]")
ATOM = "key_kind string, key string, place int, category string, rule_id string, kind string, pattern string, languages array<string>, unless string"


def _name_key(text: str) -> tuple[str, str] | None:
    """The key of a pattern of one component: its whole text, its extension, or its first letters."""
    if not text.isascii():
        return None
    if not _WILD.search(text):
        return "name", text.lower()
    tail, head = _WILD.split(text)[-1], _WILD.split(text)[0]
    if "." in tail:
        return "extension", tail[tail.rindex(".") :].lower()
    return ("head", head[:HEAD].lower()) if len(head) >= HEAD else None


def key_of(kind: str, text: str) -> tuple[str, str] | None:
    """What every path that the pattern matches has, or None."""
    if kind == "signal":
        return "signal", text
    if kind == "name":
        return _name_key(text)
    if kind == "dir":
        return ("dir", text.lower()) if text.isascii() and not _WILD.search(text) else None
    *above, last = text.split("/")
    named = [part for part in above if part.isascii() and not _WILD.search(part)]
    return (_name_key(last) if last != "**" else None) or (("dir", max(named, key=len).lower()) if named else None)


def atoms(rules: Sequence[Rule]) -> Iterator[tuple]:
    """One row for each pattern with its key, or None for a rule that has a pattern without one."""
    for place, rule in enumerate(rules):
        texts = [(t, p) for p in rule.patterns for t in ([p] if rule.kind == "signal" else expand_braces(p))]
        keys = [key_of(rule.kind, t) for t, _ in texts]
        if None in keys:
            yield place, None
            continue
        fold = flags(rule.case_sensitive)
        for key, (text, _) in zip(keys, texts):
            shape = {"signal": text, "path": fold + path_regex([text]) if rule.kind == "path" else "", "name": rf"{fold}\A{component_regex([text])}\z", "dir": rf"{fold}(?:\A|/){component_regex([text])}/"}
            pattern = shape[rule.kind]
            yield place, (*key, place, rule.category, rule.rule_id, rule.kind, pattern, list(rule.languages), fold + path_regex(rule.unless) if rule.unless else None)


def classify_indexed(files: DataFrame, rules: Sequence[Rule] = RULES, path: str = "path", signals: str | None = "signals") -> DataFrame:
    """``files`` with ``language``, ``category`` and ``rule_id``, as ``classify`` gives them."""
    spark = files.sparkSession
    found = list(atoms(rules))
    index = spark.createDataFrame([a for _, a in found if a], ATOM)
    rest = [k for k, a in found if a is None]
    none = F.array().cast("array<string>")
    given = F.coalesce(F.array_sort(signals), none) if signals else none
    known = files.withColumns({"language": language_of(normal_path(F.col(path))), "__signals": given})
    names = known.select(F.col(path).alias("__path"), F.col("__signals").alias("__held"), "language").distinct().withColumn("__normal", normal_path(F.col("__path")))
    name, low = file_name(F.col("__normal")), F.lower("__normal")
    parts = F.split(low, "/")
    last = F.element_at(parts, -1)
    keyed = lambda kind, value: F.struct(F.lit(kind).alias("key_kind"), value.alias("key"))
    keys = F.array_distinct(F.concat(
        F.array(keyed("name", last), keyed("extension", F.regexp_extract(last, r"\.[^.]*\z", 0)), keyed("head", F.substring(last, 1, HEAD))),
        F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: keyed("dir", d)), F.transform("__held", lambda s: keyed("signal", s)),
    ))
    spread = names.withColumns({"__name": name, "__dirs": layout_dirs(F.col("__normal"))}).select("*", F.explode(keys).alias("__key")).select("*", "__key.*").drop("__key")
    subject = (
        F.when(F.col("kind") == "dir", F.rlike("__dirs", F.col("pattern"))).when(F.col("kind") == "name", F.rlike("__name", F.col("pattern")))
        .when(F.col("kind") == "path", F.rlike("__normal", F.col("pattern"))).otherwise(F.array_contains("__held", F.col("pattern")))
    )
    spoken = (F.size("languages") == 0) | F.coalesce(F.array_contains("languages", F.col("language")), F.lit(False))
    free = F.col("unless").isNull() | ~F.rlike("__normal", F.col("unless"))
    hits = spread.join(index, ["key_kind", "key"]).where(subject & spoken & free)
    best = hits.groupBy("__path", "__held").agg(F.min(F.struct("place", "category", "rule_id")).alias("__indexed"))
    joined = names.select("__path", "__held", "language").join(best, ["__path", "__held"], "left")
    if rest:
        chain = [rules[k] for k in rest]
        places = F.create_map(*[F.lit(x) for k in rest for x in (rules[k].rule_id, k)])
        by_chain = classification(F.col("__path"), F.col("__held"), chain, F.col("language"))
        joined = joined.withColumn("__chain", by_chain)
        place = F.try_element_at(places, F.col("__chain.rule_id"))
        joined = joined.withColumn("__class", F.least("__indexed", F.when(place.isNotNull(), F.struct(place.alias("place"), "__chain.category", "__chain.rule_id"))))
    else:
        joined = joined.withColumn("__class", F.col("__indexed"))
    decided = joined.select("__path", "__held", F.coalesce("__class.category", F.lit(FALLBACK[0])).alias("category"), F.coalesce("__class.rule_id", F.lit(FALLBACK[1])).alias("rule_id"))
    met = known.join(decided, F.col(path).eqNullSafe(F.col("__path")) & (F.col("__signals") == F.col("__held")), "left")
    return met.drop("__signals", "__path", "__held")
