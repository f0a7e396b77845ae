"""Matching many regular expressions at once, as RE2 does it.

One alternation of some hundred patterns is slow in the JVM's backtracking
matcher and linear in RE2, so this is one of the few places where an Arrow
function beats the built-in.  Batches cross as Arrow columns; no row is boxed.
"""

from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: patterns compiled together, if RE2 takes them
GROUP = 500
#: required texts shorter than this select too little
LEAST_LITERAL = 4


def alternation(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def re2_error(pattern: str) -> str | None:
    """RE2's complaint about a pattern, or None if it compiles."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid as err:
        return str(err)
    return None


def re2_errors(c: Column) -> Column:
    """:func:`re2_error` of every pattern in a column."""

    def check(values: pa.Array) -> pa.Array:
        return pa.array([re2_error(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(check, "string")(c)


def compiled_groups(patterns: list[str]) -> list[str]:
    """Alternations of at most GROUP patterns, halved where RE2 finds the program too large."""
    groups = []
    pending = [patterns[i : i + GROUP] for i in range(0, len(patterns), GROUP)][::-1]
    while pending:
        part = pending.pop()
        if len(part) > 1 and re2_error(alternation(part)):
            pending += [part[len(part) // 2 :], part[: len(part) // 2]]
        else:
            groups.append(alternation(part))
    return groups


def required_text(pattern: str) -> str | None:
    """The longest text that every match of a pattern surely holds, or None.

    Only plain characters outside of brackets and groups count; patterns with flags,
    alternatives at the top or escapes by number are given up.
    """
    runs, run, depth, i = [], "", 0, 0

    def close() -> str:
        runs.append(run)
        return ""

    while i < len(pattern):
        c, rest = pattern[i], pattern[i + 1 :]
        if c == "\\":
            if not rest or rest[0] in "QExpPC" or rest[0].isdigit():
                return None
            run = close() if rest[0].isalnum() else run + rest[0] if depth == 0 else run
            i += 2
            continue
        if c == "[":
            end = i + 2 + rest.startswith("^")  # a bracket right behind is a member
            while end < len(pattern) and pattern[end] != "]":
                if pattern[end : end + 2] == "[:":
                    return None
                end += 2 if pattern[end] == "\\" else 1
            run, i = close(), end + 1
            continue
        if c == "(":
            if rest.startswith("?") and not rest.startswith("?:"):
                return None
            run, depth = close(), depth + 1
        elif c == ")":
            run, depth = close(), depth - 1
        elif c == "|" and depth == 0:
            return None
        elif c in "*?{":
            run = run[:-1]
            run = close()
            if c == "{":
                end = pattern.find("}", i)
                if end < 0:
                    return None
                i = end
        elif c in "+.^$|":
            run = close()
        elif depth == 0:
            run += c
        i += 1
    close()
    best = max(runs, key=len)
    return best if len(best) >= LEAST_LITERAL else None


@cache
def automaton(texts: tuple[str, ...]) -> ahocorasick.Automaton:
    """One for each list of texts and worker."""
    found = ahocorasick.Automaton()
    for i, text in enumerate(texts):
        found.add_word(text, i)
    found.make_automaton()
    return found


class ManyPatterns:
    """Patterns of any number: an automaton of their required texts names the few to try on a value.

    Those without a required text are tried on every value, in groups.
    """

    def __init__(self, patterns: list[str]):
        by_text: dict[str, list[str]] = {}
        free = []
        for pattern in dict.fromkeys(patterns):
            text = required_text(pattern)
            (free if text is None else by_text.setdefault(text, [])).append(pattern)
        self.free = compiled_groups(free)
        self.groups = [compiled_groups(p) for p in by_text.values()]
        self.texts = tuple(by_text)

    def search(self, values: pa.Array) -> pa.Array:
        """Which values any pattern matches; null for null."""
        hit = np.zeros(len(values), bool)
        for group in self.free:
            hit |= pc.fill_null(pc.match_substring_regex(values, group), False).to_numpy(zero_copy_only=False)
        rows: dict[int, set[int]] = {}
        if self.texts:
            held = automaton(self.texts).iter
            for row in np.flatnonzero(~hit).tolist():
                value = values[row].as_py()
                for _, i in held(value) if value else ():
                    rows.setdefault(i, set()).add(row)
        for i, some in rows.items():
            at = np.array(sorted(some))
            at = at[~hit[at]]
            part = values.take(pa.array(at))
            for group in self.groups[i]:
                hit[at] |= pc.match_substring_regex(part, group).to_numpy(zero_copy_only=False)
        return pa.array(hit, mask=values.is_null().to_numpy(zero_copy_only=False))


def matches_any(c: Column, patterns: list[str]) -> Column:
    """True where any pattern matches anywhere in ``c``."""
    if not patterns:
        return F.lit(False)
    if len(patterns) <= GROUP:
        groups = compiled_groups(patterns)

        def search(values: pa.Array) -> pa.Array:
            found = pc.match_substring_regex(values, groups[0])
            for group in groups[1:]:
                found = pc.or_(found, pc.match_substring_regex(values, group))
            return found

        return F.arrow_udf(search, "boolean")(c)
    many = ManyPatterns(patterns)

    def search_many(values: pa.Array) -> pa.Array:
        return many.search(values)

    return F.arrow_udf(search_many, "boolean")(c)
