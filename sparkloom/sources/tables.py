"""Adapters from the given tables to the engine's: files, lines and typed edges; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import rel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path():
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


DOC_PATH_SQL = "source || '/' || lang || '/' || doc_id || '.txt'"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, path, text: documents as text files, pages as HTML files."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_id"), doc_path().alias("path"), "text")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file_id"), F.concat(X.normal_path(F.col("url")), F.lit("/index.html")).alias("path"), F.col("html").alias("text"))
    return docs.unionByName(pages)


FILES_SQL = f"""files AS (SELECT 'd' || doc_id AS file_id, {DOC_PATH_SQL} AS path, text FROM documents
  UNION ALL SELECT 'p' || page_id, {X.normal_path_sql("url")} || '/index.html', html FROM pages)"""


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, path, line, content of every line of every file."""
    return rel.lines(files(spark, sf_dir), ["file_id", "path"])


LINES_SQL = FILES_SQL + r""",
  lines AS (SELECT file_id, path, generate_subscripts(parts, 1)::BIGINT AS line, unnest(parts) AS content FROM (SELECT *, string_split_regex(text, '\r?\n') AS parts FROM files))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed parallel edges from customers to suppliers: src, dst, type, and the files (nations) of both ends."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("type"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src_file"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst_file"))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("dst"), "type", "src_file", "dst_file")


EDGES_SQL = """edges AS (SELECT 'customer:' || o_custkey AS src, 'supplier:' || l_suppkey AS dst, l_returnflag AS type, c_nationkey AS src_file, s_nationkey AS dst_file
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
