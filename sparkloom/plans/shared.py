"""Queries that are one text of SQL over base tables, in the dialects of Spark and of DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..registry import ORACLES, QUERIES
from ..sources.repos import FILES_SQL


class Base(NamedTuple):
    """A table that a query reads: its name in SQL, the DataFrame, and DuckDB SQL of it as `name AS (...)` with what it needs before."""

    name: str
    frame: Callable[[SparkSession, str], DataFrame]
    sql: str


#: SQL that many bases begin with.
STARTS = [FILES_SQL]
#: What is written alike in both, and how either says it.
SPARK = [(r"regexp_matches\(", "regexp_like("), (r"~\(", "regexp_like("), (r"@starts\(", "startswith("), (r"@div\b", "div")]
DUCK = [(r"\bcount_if\(", "count(*) FILTER (WHERE "), (r"~\(", "regexp_matches("), (r"@starts\(", "starts_with("), (r"@div\b", "//")]
#: @set(x): the different values, sorted and joined by commas. @sha(x): the SHA-256 of a text, in hexadecimal.
SPARK_CALLS = {"@set(": "array_join(array_sort(collect_set({0})), ',')", "@sha(": "sha2({0}, 256)"}
DUCK_CALLS = {"@set(": "coalesce(string_agg(DISTINCT {0}, ',' ORDER BY {0}), '')", "@sha(": "sha256({0})"}


def call(text: str, name: str, said: str) -> str:
    """text with each call of name in the other form; its argument ends at the parenthesis that closes it."""
    while (at := text.rfind(name)) >= 0:
        end, depth = at + len(name), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = text[:at] + said.format(text[at + len(name) : end - 1]) + text[end:]
    return text


def spoken(text: str, spark: bool) -> str:
    if spark:
        text = text.replace("\\", "\\\\")
    for name, said in (SPARK_CALLS if spark else DUCK_CALLS).items():
        text = call(text, name, said)
    for sign, said in SPARK if spark else DUCK:
        text = re.sub(sign, said, text)
    return text


def is_cte(text: str) -> bool:
    return re.match(r"\s*\w+ AS (MATERIALIZED )?\(", text) is not None


def tables(bases: list[Base]) -> list[str]:
    """The bases' SQL; what several begin with is said once."""
    out: list[str] = []
    for b in bases:
        own = b.sql
        for first in STARTS:
            if own.startswith(first) and any(first in x for x in out):
                own = own[len(first) :].removeprefix(", ")
        if own:
            out.append(own)
    return out


def define(name: str, bases: list[Base], text: str, doc: str, run: Callable | None = None) -> Callable:
    """Registers a query whose SQL is text: `a AS (...), b AS (...) SELECT ...` or `SELECT ...`.

    run (spark, sf_dir) answers it in Spark where the text as it stands would build too much.
    """
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    own = spoken(text, True)

    def said_in_spark(spark: SparkSession, sf_dir: str) -> DataFrame:
        for b in bases:
            b.frame(spark, sf_dir).createOrReplaceTempView(b.name)
        return spark.sql(("WITH " if is_cte(own) else "") + own)

    run = run or said_in_spark
    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    said = spoken(text, False)
    ORACLES[name] = "WITH " + ", ".join(tables(bases)) + (", " if is_cte(said) else " ") + said
    return run
