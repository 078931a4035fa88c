"""Queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hilbert, licenses, lm_scoring, minhash, mixing, packing, quality_rules, spherical, substring, token_output
from .common import table, written_folder


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token dataset, written by the sink to the shared folder and read again."""
    tokens = token_output.tokenize(table(spark, sf_dir, "documents"))
    folder = written_folder(spark, "tokens")
    token_output.write_tokens(tokens, folder)
    return spark.read.parquet(folder)


def op3_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean(table(spark, sf_dir, "documents"), report=True)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.classes(table(spark, sf_dir, "embeddings"))


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.selected(table(spark, sf_dir, "documents"), keep=["doc_id", "source", "lang"])
    return chosen.select("doc_id", "source", "lang", F.col("__words").alias("n_words"), F.col("__pattern").alias("pattern"), F.col("__copies").alias("copies"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_hilbert_shards, op2_token_output, op3_quality_lines, op4_repeated_passages, op5_best_fit_packing, op6_spherical_caps, op7_weighted_minhash, op8_stupid_backoff, op9_source_mixing, op10_license_scan)}
ORACLES = {"op1_hilbert_shards": hilbert.shard_sql(), "op3_quality_lines": quality_rules.clean_sql(report=True), "op8_stupid_backoff": lm_scoring.score_sql()}
