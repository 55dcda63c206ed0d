"""Native column functions over paths, messages, lines, hashes and addresses.

Everything here is a JVM expression. The regular expressions are in Java's dialect: ``(?d)`` keeps
``\\n`` the only line end where that matters, ``(?U)`` makes classes and word boundaries Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as Unicode text splitting sees it, and all line ends (fixed values).
SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

#: The language of each extension (fixed values).
EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".pyx": "python", ".pxd": "python", ".rs": "rust",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".go": "go", ".java": "java",
}

#: How messages refer to issues and speak of fixes (fixed values: words and patterns). First letters are looked for ahead of word boundaries, which cost more.
_CLOSING = r"(?=[cfr])\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\b:?\s+"
CLOSING_REFERENCE = rf"(?iU){_CLOSING}((?:[\w.-]+/[\w.-]+)?#\d+|https://github\.com/\S+/(?:issues|pull)/\d+)"
BARE_REFERENCE = r"(?iU)(?<![\w/&])(?:[\w.-]+/[\w.-]+)?#\d+\b|\bgh-\d+\b|https://github\.com/\S+/(?:issues|pull)/\d+"
CLOSED_ISSUE = rf"(?iU){_CLOSING}(?:([\w.-]+/[\w.-]+)?#(\d+)\b|https?://github\.com/([\w.-]+/[\w.-]+)/issues/(\d+)\b)"
FIX_WORD = r"(?iU)(?=[fbrciw])\b(fix(?:e[sd]|ing)?|bug(?:s|fix)?|regression|crash(?:es|ed)?|incorrect(?:ly)?|wrong|broken)\b"
FIX_LABEL = r"(?iU)\b(?:bugs?|bugfix|fix(?:es)?|regression|crash(?:es)?)\b"


# --- paths -------------------------------------------------------------------------------------


def normal_path(path: Column) -> Column:
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashed.startswith("./"), F.regexp_replace(slashed, r"\A(?:\./)+", "")).otherwise(slashed)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def layout_dirs(path: Column) -> Column:
    """The directories as text that ends in a slash, cut below ``src/<set>/java/``."""
    dirs = F.substring(path, F.lit(1), F.length(path) - F.length(file_name(path)))
    root = F.regexp_extract(dirs, r"\A(?:[^/]*/)*?src/[^/]*/java/", 0)
    return F.when(dirs.contains("/java/") & (root != ""), root).otherwise(dirs)


def extension(path: Column) -> Column:
    """The lower-case ending from the last dot on, if something stands before it; else empty."""
    name = file_name(F.replace(path, F.lit("\\"), F.lit("/")))
    tail = F.substring_index(name, ".", -1)
    return F.when(F.length(name) > F.length(tail) + 1, F.lower(F.concat(F.lit("."), tail))).otherwise("")


def language_of(path: Column) -> Column:
    """The language of a path's extension, or null."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(known, extension(path))


# --- lines and messages ------------------------------------------------------------------------


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def normalize_line(line: Column) -> Column:
    """Without outer white space, inner runs as one blank. Visible ASCII and single blanks, the usual case, are passed over at once."""
    return F.regexp_replace(strip(line), rf"(?![!-~])(?:[{SPACE}]{{2,}}|[{SPACE}&&[^ ]])", " ")


def let(value: Column, body, kind: str | None = None) -> Column:
    """``body`` of a value that is computed once, however often the body reads it.

    ``kind`` is the type of the body. Without it the tree of the body is asked for its type at every row.
    """
    if kind:
        return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: body(x))
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_lines(text: Column) -> Column:
    """Lines by any line end; a final line end opens no further line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END))


def _parts(message: Column) -> Column:
    """(head, rest): the lines up to the first blank one, and those behind it. Lines and their end are found once."""
    nothing = F.array().cast("array<string>")

    def cut(lines: Column, blank: Column) -> Column:
        head = F.when(blank > 0, F.slice(lines, F.lit(1), F.greatest(blank - 1, F.lit(0)))).otherwise(lines)
        rest = F.when(blank > 0, F.slice(lines, blank + 1, F.greatest(F.size(lines), F.lit(1)))).otherwise(nothing)
        return F.struct(head.alias("head"), rest.alias("rest"))

    def placed(lines: Column) -> Column:
        blank = F.array_position(F.transform(lines, lambda x: strip(x) == ""), F.lit(True)).cast("int")
        return let(blank, lambda k: cut(lines, k), kind)

    kind = "struct<head:array<string>,rest:array<string>>"
    return let(F.regexp_replace(message, r"\A\n+|\n+\z", ""), lambda text: let(split_lines(text), placed, kind), kind)


#: A first line of visible ASCII and inner blanks that is a paragraph of its own: the subject of most messages.
PLAIN_SUBJECT = r"\A\n*([!-~](?:[ -~]*[!-~])?)(?:\n\n|\n*\z)"


def subject(message: Column) -> Column:
    """The first paragraph as one line. Lines are split only where the first one is no plain paragraph."""
    split = F.array_join(F.transform(_parts(message)["head"], strip), " ")
    return let(F.regexp_extract(message, PLAIN_SUBJECT, 1), lambda plain: F.when(plain != "", plain).otherwise(split), "string")


def body(message: Column) -> Column:
    return strip(F.array_join(_parts(message)["rest"], "\n"))


def base(parents: Column) -> Column:
    return F.get(parents, F.lit(0))


def instant(date: Column) -> Column:
    """Microseconds of an ISO date with its offset."""
    return F.unix_micros(F.try_to_timestamp(date))


def normalize_date(date: Column) -> Column:
    return F.regexp_replace(date, r"Z\z", "+00:00")


def plural(count: Column, word: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {word}"), F.when(count == 1, "").otherwise("s"))


# --- references --------------------------------------------------------------------------------


#: What is told of a message.
TOLD = "struct<value:double,detail:string>"


def linked_reference(message: Column, pull: Column | None = None) -> Column:
    """A struct (value, detail): 1 for a closing reference, 0.5 for a bare one or any pull request."""
    # each expression is tried once, where a sign is that it needs, and the second only where the first found nothing
    sign = message.contains("#") | message.contains("/")
    closing = F.when(sign, F.regexp_extract(message, CLOSING_REFERENCE, 0)).otherwise("")
    bare = F.when(sign | message.contains("-"), F.regexp_extract(message, BARE_REFERENCE, 0)).otherwise("")
    found = let(closing, lambda c: F.struct(c.alias("closing"), F.when(c == "", bare).otherwise("").alias("bare")), "struct<closing:string,bare:string>")
    return let(found, lambda m: _referred(m["closing"], m["bare"] if pull is None else F.regexp_extract(message, BARE_REFERENCE, 0), pull), TOLD)


def _referred(closing: Column, bare: Column, pull: Column | None) -> Column:
    def told(value: float, detail: Column) -> Column:
        return F.struct(F.lit(value).alias("value"), detail.alias("detail"))

    plain = F.when(closing != "", told(1.0, closing)).when(bare != "", told(0.5, bare)).otherwise(told(0.0, F.lit("no issue or pull-request reference")))
    if pull is None:
        return plain
    number = pull["number"].cast("string")
    closes = F.concat(F.lit("pull request #"), number, F.lit(" closes "), F.array_join(pull["linked_issues"], ", "))
    request = F.when(F.size(pull["linked_issues"]) > 0, told(1.0, closes)).when(bare != "", told(0.5, bare))
    request = request.otherwise(told(0.5, F.concat(F.lit("pull request #"), number, F.lit(", no closing keyword"))))
    return F.when(pull.isNull(), plain).otherwise(request)


def fix_keyword(subject_: Column, labels: Column | None = None) -> Column:
    """A struct (value, detail): 1 if the subject reads like a fix, or a label says so."""
    return let(F.regexp_extract(subject_, FIX_WORD, 0), lambda word: _worded(word, labels), TOLD)


def _worded(word: Column, labels: Column | None) -> Column:
    none, value = F.lit("no fix keyword in the subject"), F.when(word != "", 1.0)
    detail = F.when(word != "", word)
    if labels is not None:
        label = F.get(F.filter(labels, lambda x: x.rlike(FIX_LABEL)), F.lit(0))
        value, detail = value.when(label.isNotNull(), 1.0), detail.when(label.isNotNull(), F.concat(F.lit("label '"), label, F.lit("'")))
        none = F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.concat(none, F.lit(" or labels"))).otherwise(none)
    return F.struct(value.otherwise(0.0).alias("value"), detail.otherwise(none).alias("detail"))


def linked_issues(texts: Column, repo: Column) -> Column:
    """The issues that texts close: those of the repository first, each list by number."""
    matches = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(CLOSED_ISSUE), F.lit(0))))

    def parsed(match: Column) -> Column:
        group = lambda k: F.regexp_extract(match, CLOSED_ISSUE, k)
        where, number = F.concat(group(1), group(3)), F.concat(group(2), group(4)).cast("decimal(38,0)")
        return F.struct(F.when(F.lower(where) == F.lower(repo), "").otherwise(where).alias("where"), number.alias("number"))

    return F.transform(F.array_sort(F.array_distinct(F.transform(matches, parsed))), lambda x: F.concat(x["where"], F.lit("#"), x["number"].cast("string")))


# --- hashes ------------------------------------------------------------------------------------


def digest(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def _filled(lines: Column, shape) -> Column:
    return F.filter(F.transform(lines, shape), lambda x: x != "")


def _signed(lines: Column, sign: str) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit(sign), x, F.lit("\n"))), "")


def hunk_hash(deleted: Column, added: Column) -> Column:
    """The hash of a hunk's collapsed lines; of its stripped lines if those tell the sides apart; else null."""

    def hashed(shape, head: str, other) -> Column:
        sides = F.struct(_filled(deleted, shape).alias("old"), _filled(added, shape).alias("new"))
        text = lambda s: F.concat(F.lit(head), _signed(s["old"], "-"), _signed(s["new"], "+"))
        return let(sides, lambda s: F.when(s["old"] != s["new"], digest(text(s))).otherwise(other), "string")

    return hashed(normalize_line, "", hashed(strip, "INNER\n", F.lit(None).cast("string")))


def patch_hash(hunks: Column) -> Column:
    """The hash of a multiset of hunk hashes."""
    return digest(F.array_join(F.transform(F.array_sort(hunks), lambda h: F.concat(h, F.lit("\n"))), ""))


def overlap(first: Column, second: Column) -> Column:
    """A struct (shared, share): common distinct members, and their share of the smaller set."""
    a, b = F.array_distinct(first), F.array_distinct(second)
    shared, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    some = F.coalesce(least > 0, F.lit(False))
    return F.struct(F.when(some, shared).otherwise(0).alias("shared"), F.when(some, shared / least).otherwise(0.0).alias("share"))


# --- addresses ---------------------------------------------------------------------------------

_USER = r"\A([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*)@"


def strip_credentials(url: Column) -> Column:
    """An address without user and password; ``ssh`` keeps its user."""
    scheme, user = F.regexp_extract(url, _USER, 1), F.element_at(F.split(F.regexp_extract(url, _USER, 2), ":"), 1)
    kept = F.when((F.lower(scheme) == "ssh://") & (user != ""), F.concat(user, F.lit("@"))).otherwise("")
    return F.when(url.rlike(_USER), F.concat(scheme, kept, F.regexp_replace(url, _USER, ""))).otherwise(url)


def web_url(url: Column) -> Column:
    """The address of a repository in a browser, from a web address or a remote, or null."""
    plain = strip_credentials(F.trim(url))
    plain = F.regexp_replace(F.regexp_replace(plain, r"/\z", ""), r"\.git\z", "")
    remote, short = r"\A(?:ssh|git)://(?:[^/@]*@)?([^/:]+)(?::\d+)?/(.+)\z", r"\A[^/@:]+@([^/:]+):(.+)\z"

    def told(pattern: str) -> Column:
        return F.concat(F.lit("https://"), F.regexp_extract(plain, pattern, 1), F.lit("/"), F.regexp_replace(F.regexp_extract(plain, pattern, 2), r"\A/+", ""))

    return F.when(plain.rlike(r"(?i)\Ahttps?://"), plain).when(plain.rlike(remote), told(remote)).when(plain.rlike(short), told(short))


def short_name(sha: Column, pull_number: Column | None = None) -> Column:
    """``#number`` of a pull request, else ten digits of the sha."""
    plain = F.substring(sha, 1, 10)
    return plain if pull_number is None else F.when(pull_number.isNotNull(), F.concat(F.lit("#"), pull_number.cast("string"))).otherwise(plain)


def clip(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)
