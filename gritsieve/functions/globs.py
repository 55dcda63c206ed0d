"""Globs for classifier rules, compiled to one anchored Java expression each.

``*`` and ``?`` stay within a path component, ``[...]`` is a class, ``{a,b}`` gives alternatives, and
``**`` as a whole segment stands for any number of directories. Patterns are checked when they are
compiled, so one that could never match is an error and not a rule that does nothing.
"""

from __future__ import annotations

import re

MAX_ALTERNATIVES = 256
_ANY_DIRS, _ANY_NAME = "(?:[^/]*/)*", "[^/]*"
#: A class as it is read: an optional ``!``, a first character that may be ``]``, up to the next ``]``.
_CLASS = re.compile(r"\[(!?)(\]?[^\]]*)\]", re.DOTALL)


class GlobError(ValueError):
    """A pattern is malformed or can never match."""


def _pieces(pattern: str) -> list[str]:
    """The pattern cut into classes, brace groups and single characters."""
    found, at = [], 0
    while at < len(pattern):
        whole = _CLASS.match(pattern, at)
        close = pattern.find("}", at) if pattern[at] == "{" else -1
        size = len(whole[0]) if whole else close + 1 - at if close > 0 else 1
        found.append(pattern[at : at + size])
        at += size
    return found


def expand_braces(pattern: str) -> tuple[str, ...]:
    """The alternatives of a pattern, in order."""
    texts = [""]
    for piece in _pieces(pattern):
        options = piece[1:-1].split(",") if len(piece) > 1 and piece[0] == "{" else [piece]
        texts = [text + option for text in texts for option in options]
        if len(texts) > MAX_ALTERNATIVES:
            raise GlobError(f"{pattern!r}: gives more than {MAX_ALTERNATIVES} patterns")
    return tuple(texts)


def _ranges(body: str) -> list[tuple[str, str]]:
    """The members of a class as ranges; single characters are ranges of one."""
    members, at = [], 0
    while at < len(body):
        step = 3 if body[at + 1 : at + 2] == "-" and at + 2 < len(body) else 1
        members.append((body[at], body[at + step - 1]))
        at += step
    return members


def _segment_regex(segment: str) -> str:
    """One brace-free component as an expression that never crosses a slash."""
    out = []
    for piece in _pieces(segment):
        whole = _CLASS.fullmatch(piece) if len(piece) > 1 else None
        if whole:
            body = "".join(f"\\x{{{ord(a):x}}}-\\x{{{ord(b):x}}}" for a, b in _ranges(whole[2]))
            out.append(f"(?!/)[{'^' if whole[1] else ''}{body}]")
        else:
            out.append({"*": _ANY_NAME, "?": "[^/]"}.get(piece, "".join(f"\\x{{{ord(c):x}}}" if not c.isalnum() else c for c in piece)))
    return "".join(out)


def check_pattern(pattern: str, kind: str) -> None:
    """Raise for a pattern that is malformed or can never match; ``kind`` is component or path."""
    if not pattern:
        raise GlobError("there is no pattern")
    if "\\" in pattern:
        raise GlobError(f"{pattern!r}: no path has a backslash here, write /")
    if kind == "component" and "/" in pattern:
        raise GlobError(f"{pattern!r}: names have no slash; a path pattern may")
    if kind == "path" and pattern[0] + pattern[-1] != (pattern[0] + pattern[-1]).strip("/"):
        raise GlobError(f"{pattern!r}: no slash may open or close a path pattern")
    for text in expand_braces(pattern):
        if not text:
            raise GlobError(f"{pattern!r}: one of the alternatives is nothing")
        if kind == "path" and "" in text.split("/"):
            raise GlobError(f"{pattern!r}: nothing between two slashes of {text!r}")
        for piece in _pieces(text):
            whole = _CLASS.fullmatch(piece) if len(piece) > 1 else None
            for low, high in _ranges(whole[2]) if whole else ():
                if low > high:
                    raise GlobError(f"{pattern!r}: the range {low}-{high} is backwards")


def component_regex(patterns: tuple[str, ...] | list[str]) -> str:
    """Any of the patterns as the whole of one component, without anchors."""
    return "(?:" + "|".join(_segment_regex(text) for p in patterns for text in expand_braces(p)) + ")"


def path_regex(patterns: tuple[str, ...] | list[str]) -> str:
    """Any of the patterns as a whole path, anchored."""

    def one(text: str) -> str:
        whole = text.split("/")
        segments = [s for k, s in enumerate(whole) if not k or s != "**" or whole[k - 1] != "**"]
        parts = [_ANY_DIRS if s == "**" else _segment_regex(s) + ("/" if k + 1 < len(segments) else "") for k, s in enumerate(segments)]
        return "".join(parts) + (_ANY_NAME if segments[-1] == "**" else "")

    return r"\A(?:" + "|".join(one(text) for p in patterns for text in expand_braces(p)) + r")\z"


def literal_part(pattern: str) -> str:
    """The longest plain text that every path matched by the pattern holds, slashes apart; may be empty."""
    if not pattern.isascii() or "{" in pattern:
        return ""
    return max(re.split(r"[*?/]|\[!?\]?[^\]]*\]", pattern), key=len)


def simple_shape(text: str) -> tuple[str, ...] | None:
    """("is", a), ("around", a, b) or ("holds", a) for the components ``a``, ``a*b`` and ``*a*``; None for others."""
    pieces = text.split("*")
    if not text.isascii() or "?" in text or "[" in text:
        return None
    if len(pieces) <= 2:
        return ("is", text) if len(pieces) == 1 else ("around", *pieces)
    return ("holds", pieces[1]) if len(pieces) == 3 and not pieces[0] and not pieces[2] and pieces[1] else None


def fixed_ending(shape: tuple[str, ...]) -> str | None:
    """What stands behind the last dot of every name of a shape (the whole name without a dot), or None."""
    how, first, *last = shape
    if how == "is":
        return first.rpartition(".")[2]
    return last[0].rpartition(".")[2] if how == "around" and "." in last[0] else None


def flags(case_sensitive: bool) -> str:
    return "" if case_sensitive else "(?iu)"
