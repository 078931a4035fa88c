"""Ordered rules over text: one table of patterns gives the Spark Column and the DuckDB SQL.

Patterns use no look-around and no flags but (?i), so Java's and RE2's engines agree on them.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as sre
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value!r}::DOUBLE" if isinstance(value, float) else repr(value)


def any_of(*words: str) -> str:
    """An alternation, longest first, so no word hides a longer one."""
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


def required(pattern: str) -> tuple[list[list[str]], bool]:
    """Words without which a pattern can't match, one of each list, and whether their letters' case doesn't count.

    Only what every match has to hold is read off: runs of literals, and alternatives of which each has such a run.
    """
    parsed = _parser.parse(pattern)

    def lists(items) -> list[list[str]]:
        out, run = [], ""
        for op, arg in [*items, (sre.ANY, None)]:
            if op is sre.LITERAL:
                run += chr(arg)
                continue
            if op is sre.AT:
                continue
            if run:
                out.append([run])
            run = ""
            if op is sre.SUBPATTERN:
                out += lists(arg[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                out += lists(arg[2])
            elif op is sre.IN and len(arg) <= 4 and all(o is sre.LITERAL for o, _ in arg):
                out.append([chr(c) for _, c in arg])
            elif op is sre.BRANCH:
                each = [max(lists(a), key=lambda words: min(map(len, words)), default=None) for a in arg[1]]
                if all(each):
                    out.append(sorted({w for words in each for w in words}))
        return out

    return lists(parsed), bool(parsed.state.flags & re.IGNORECASE)


def may_match(text: Column, pattern: str) -> Column:
    """False only where a pattern can't match a text: searches for words are far cheaper than regular expressions."""
    words, any_case = required(pattern)
    if any_case:
        text, words = F.lower(text), [[w.lower() for w in ws] for ws in words if all(w.isascii() for w in ws)]
    groups = [reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in ws]) for ws in words]
    return reduce(lambda a, b: a & b, groups) if groups else F.lit(True)


def telling(patterns: list[str]) -> list[str]:
    """Words of which a text has one at least if any of the patterns matches it: of each pattern the list that is rarest in prose."""
    rare = lambda ws: min(len(w) + 5 * any(x in "(){}<>=@'\"" for x in w) for w in ws)
    words = {w for p in patterns for w in max(required(p)[0], key=rare)}
    return sorted(w for w in words if not any(v != w and v in w for v in words))


class Cases:
    """The label of the first pattern that a text matches; otherwise the default. Labels are strings, numbers or null."""

    def __init__(self, rules: list[tuple[str, object]], default=None, rooted: bool = False):
        self.rules, self.default, self.rooted = rules, default, rooted

    def column(self, text: Column) -> Column:
        text = F.concat(F.lit("/"), text) if self.rooted else text
        out = reduce(lambda c, r: c.when(text.rlike(r[0]), F.lit(r[1])), self.rules, F)
        return out.otherwise(F.lit(self.default)) if self.default is not None else out

    def sql(self, text: str) -> str:
        text = f"('/' || {text})" if self.rooted else text
        return "CASE " + " ".join(f"WHEN regexp_matches({text}, {quoted(p)}) THEN {quoted(v)}" for p, v in self.rules) + f" ELSE {quoted(self.default)} END"


class Holds:
    """Whether a text matches one pattern of each group of wanted, and none of unwanted."""

    def __init__(self, *wanted: str | tuple[str, ...], no: tuple[str, ...] = ()):
        self.wanted, self.no = [(w,) if isinstance(w, str) else w for w in wanted], no

    def column(self, text: Column) -> Column:
        groups = [reduce(lambda a, b: a | b, [text.rlike(p) for p in g]) for g in self.wanted]
        return reduce(lambda a, b: a & b, groups + [~text.rlike(p) for p in self.no])

    def sql(self, text: str) -> str:
        groups = ["(" + " OR ".join(f"regexp_matches({text}, {quoted(p)})" for p in g) + ")" for g in self.wanted]
        return "(" + " AND ".join(groups + [f"NOT regexp_matches({text}, {quoted(p)})" for p in self.no]) + ")"
