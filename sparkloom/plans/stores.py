"""Stores as queries: what is written as JSON and read again, JSON within text, and manifests that are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpoint_folder
from ..registry import query
from ..sources import manifests, repos, stores
from ..sources.tables import table


def folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT 'claim:' || doc_id AS claim_id, 'file:' || doc_id AS subject, CASE quality WHEN 1 THEN 'accepted' ELSE 'rejected' END AS status, quality::DOUBLE AS confidence FROM labels")
def claims_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, written as JSON lines after their checks and read again by their schema."""
    claims = table(spark, sf_dir, "labels").selectExpr("concat('claim:', doc_id) AS claim_id", "concat('file:', doc_id) AS subject", "CASE quality WHEN 1 THEN 'accepted' ELSE 'rejected' END AS status", "cast(quality AS double) AS confidence")
    checks = [claims.where("confidence < 0 OR confidence > 1").selectExpr("claim_id AS subject", "'CONFIDENCE_OUT_OF_RANGE' AS issue"), claims.where("claim_id IS NULL").selectExpr("subject", "'ID_MISSING' AS issue")]
    path = folder(spark, "claims")
    stores.write_checked(claims, checks, path)
    return stores.read_lines(spark, path, claims.schema)


SAID_SQL = "CASE event_id % 4 WHEN 0 THEN 'Result: ```json' || chr(10) || props || chr(10) || '``` done' WHEN 1 THEN 'It is ' || props || ' so' WHEN 2 THEN 'All: [' || props || '] end' ELSE 'no result' END"


@query("SELECT event_id, event_id % 4 <> 3 AS found, CASE WHEN event_id % 4 = 2 THEN '[' || replace(props, ' ', '') || ']' WHEN event_id % 4 < 2 THEN replace(props, ' ', '') END AS json, CASE WHEN event_id % 4 < 2 THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events")
def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON that is found in answers of several forms (fenced, bare, in an array, none), and a field of it."""
    said = table(spark, sf_dir, "events").select("event_id", F.expr(SAID_SQL.replace("chr(10)", "'\\n'")).alias("text"))
    found = stores.embedded_json(F.col("text"))
    return said.select("event_id", found.isNotNull().alias("found"), stores.canonical(found).alias("json"), F.get_json_object(found, "$.k").cast("long").alias("k"))


@query("SELECT event_type, 'structure:sha256:' || sha256(replace(props, ' ', '')) AS fingerprint, count(*) AS events FROM events GROUP BY ALL")
def structure_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads by the hash of their canonical form."""
    return table(spark, sf_dir, "events").groupBy("event_type", stores.structure_fingerprint(F.col("props")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("events"))


@query(f"WITH {repos.DEPENDENCIES_SQL}, {repos.MANIFESTS_SQL} SELECT m.repo || '/' || m.path AS path, lower(m.path) AS type, name, version, 'dependencies' AS scope FROM deps d JOIN manifests m ON d.repo = m.repo WHERE m.path IN ('package.json', 'requirements.txt', 'composer.json') AND NOT (m.path = 'requirements.txt' AND starts_with(name, '@'))")
def manifest_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies read from the texts of manifests in three dialects, which hold those of their repositories. A scoped name is none in requirements."""
    deps, own = repos.dependencies(spark, sf_dir), repos.manifests(spark, sf_dir)
    entries = F.sort_array(F.collect_list(F.struct("name", "version")))
    grouped = deps.groupBy("repo").agg(F.to_json(F.map_from_entries(entries)).alias("json"), F.array_join(F.transform(entries, lambda e: F.concat(e["name"], F.lit(" "), e["version"])), "\n").alias("lines"))
    written = own.withColumnRenamed("path", "file").join(grouped, "repo").withColumn("path", F.concat("repo", F.lit("/"), "file"))
    text = F.when(F.col("file") == "package.json", F.concat(F.lit('{"name": "x", "dependencies": '), "json", F.lit("}"))).when(F.col("file") == "composer.json", F.concat(F.lit('{"require": '), "json", F.lit("}")))
    said = written.where(F.col("file").isin("package.json", "composer.json")).select("path", text.alias("text"))
    required = deps.join(own.where("path = 'requirements.txt'").select("repo"), "repo").groupBy("repo").agg(F.array_join(F.sort_array(F.collect_list(F.concat("name", F.lit(" =="), F.substring("version", 2, 20)))), "\n").alias("text"))
    read = manifests.dependencies(said.unionByName(required.select(F.concat("repo", F.lit("/requirements.txt")).alias("path"), "text")))
    version = F.when(F.startswith("version", F.lit("==")), F.concat(F.lit("^"), F.substring("version", 3, 20))).otherwise(F.col("version"))
    return read.select("path", "type", "name", version.alias("version"), "scope")
