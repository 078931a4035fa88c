"""Constraints as queries: each gives the rows that violate it, or a summary with the number checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def foreign_key(child: DataFrame, key: str, parent: DataFrame, parent_key: str, code: str) -> DataFrame:
    """One row: how many keys were checked, and how many have no parent."""
    known = parent.select(F.col(parent_key).alias("__k")).distinct().withColumn("__known", F.lit(1))
    joined = child.where(F.col(key).isNotNull()).join(known, child[key] == known["__k"], "left")
    return joined.agg(F.lit(code).alias("code"), F.count(F.lit(1)).alias("checked"), F.coalesce(F.sum(F.when(F.col("__known").isNull(), 1).otherwise(0)), F.lit(0)).cast("long").alias("violations"))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def contiguity(df: DataFrame, by: list[str], position: str, start: int = 0) -> DataFrame:
    """Per group: rows, first and last position, and the number of steps that aren't one."""
    w = Window.partitionBy(*by).orderBy(position)
    gap = F.coalesce((F.col(position) - F.lag(position).over(w) != 1).cast("int"), (F.col(position) != start).cast("int"))
    return df.withColumn("__gap", gap).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min(position).alias("first"), F.max(position).alias("last"), F.sum("__gap").cast("long").alias("gaps"))


def cover(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys of a full outer join with their state: covered, missing, unexpected or repeated."""
    a = expected.select(F.col(key).alias("__e")).distinct()
    b = actual.groupBy(F.col(key).alias("__a")).agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("n") > 1, "repeated").otherwise("covered")
    return a.join(b, F.col("__e") == F.col("__a"), "full_outer").select(F.coalesce("__e", "__a").alias(key), state.alias("state"))


def mismatch(df: DataFrame, key: list[str], claimed: Column, actual: Column) -> DataFrame:
    return df.where(~claimed.eqNullSafe(actual)).select(*key, claimed.alias("claimed"), actual.alias("actual"))
