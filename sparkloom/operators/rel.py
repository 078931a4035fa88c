"""Relational operators with explicit order, so first-wins and limit semantics are deterministic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row a line: the key columns, line (from 1) and content."""
    return df.select(*key, F.posexplode(F.split(text, "\r?\n")).alias("line0", "content")).select(*key, (F.col("line0") + 1).cast("long").alias("line"), "content")


def first_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle where it can."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def distinct_on(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each key."""
    return first_n(df, by, order, 1)


def histogram(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def upsert(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of base whose key isn't in new, and all of new."""
    return base.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def rule_scan(rows: DataFrame, content: Column, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A row for each rule that a row's content matches. Patterns run in one pass over the rows; no join."""
    hits = F.array(*[F.when(content.rlike(pattern), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, pattern in rules])
    return rows.withColumn("__hit", F.explode(F.filter(hits, lambda h: h.isNotNull()))).select("*", "__hit.rule", "__hit.severity").drop("__hit")


def with_all_rules(counts: DataFrame, rules: list[tuple[str, str, str]], measures: list[str]) -> DataFrame:
    """Adds the rules without a match, with zeros."""
    every = counts.sparkSession.createDataFrame([(n, s) for n, s, _ in rules], "rule string, severity string")
    return F.broadcast(every).join(counts, "rule", "left").select("rule", "severity", *[F.coalesce(m, F.lit(0).cast("long")).alias(m) for m in measures])


def running_before(value: Column, by: list[str], order: list[Column]) -> Column:
    """Sum of the values before a row."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """The longest root that contains each path, '.' where none does.

    Each path explodes to its ancestors and meets roots by equality, so there is no theta join.
    """
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tried = paths.select(path, F.explode(ancestors).alias(root)).join(roots.select(root).distinct(), root)
    best = tried.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return paths.join(best, path, "left").withColumn(root, F.coalesce(root, F.lit(".")))


def argmax(df: DataFrame, by: list[str], value: str, count: str) -> DataFrame:
    """The value with the greatest count in each group; ties go to the least value."""
    return df.groupBy(*by).agg(F.min_by(F.struct(value, count), F.struct(-F.col(count), F.col(value))).alias("__best")).select(*by, f"__best.{value}", f"__best.{count}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
