"""Small helpers that the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import buffers, slices

WORD_BYTES = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors share; a temporary one only in local mode where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sparkloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage is cut and columns stay prunable."""
    spark = df.sparkSession
    path = written_folder(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession, each: int = 1) -> int:
    return max(1, each * int(spark.conf.get("spark.sql.shuffle.partitions")))


def word_count(text: Column) -> Column:
    """Number of words: runs without ASCII white space. Null has none. Counted on byte arrays, without Python strings."""

    def count(column: pa.Array) -> pa.Array:
        at, data = buffers(column)
        out = np.zeros(len(at) - 1, np.int64)
        for lo, hi in slices(at):
            own = WORD_BYTES[data[at[lo] : at[hi]]]
            first = own.copy()
            first[1:] &= ~own[:-1]
            edge = at[lo:hi] - at[lo]
            edge = edge[edge < len(own)]
            first[edge] = own[edge]
            total = np.concatenate(([0], np.cumsum(first)))
            out[lo:hi] = np.diff(total[at[lo : hi + 1] - at[lo]])
        return pa.array(out)

    # Not deterministic for the optimizer, which would otherwise count once more for each use.
    return F.arrow_udf(count, "long").asNondeterministic()(text)


def shielded(docs: DataFrame, run) -> DataFrame:
    """run(docs), where columns that begin with two underscores, as run's own do, have other names meanwhile."""
    names = {c: f"__shielded_{i}" if c.startswith("__") else c for i, c in enumerate(docs.columns)}
    back = {n: c for c, n in names.items()}
    out = run(docs.select(*[docs[f"`{c}`"].alias(n) for c, n in names.items()]))
    return out.select(*[out[f"`{c}`"].alias(back.get(c, c)) for c in out.columns])


@contextmanager
def shuffle_files_go(spark: SparkSession):
    """What runs inside drops its shuffle files when it ends, so steps that are written don't add up on disk."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, was)
