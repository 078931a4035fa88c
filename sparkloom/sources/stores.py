"""JSON stores: lines, documents and folders of them, with declared schemas, checks before a write, and text that holds JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Invalid(ValueError):
    """What was to be written breaks a constraint."""


def layout(package: str) -> dict[str, str]:
    """Where the parts of a package lie."""
    parts = {"inventory": "static/repo-inventory", "graph": "static/program-graph", "communities": "static/communities", "claims": "semantic/claims", "evidence": "semantic/evidence", "journeys": "journeys/definitions", "bindings": "journeys/bindings", "events": "workflow/run-events", "traces": "workflow/agent-traces", "maps": "maps", "batches": "planning/batches", "zones": "planning/zones"}
    return {name: f"{package.rstrip('/')}/{path}" for name, path in parts.items()}


def write_lines(df: DataFrame, path: str) -> None:
    """Replaces a folder of JSON lines; readers see the old or the new one, as a job's files appear when it commits."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; blank ones are skipped. What doesn't parse is an error, not a row of nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_documents(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All JSON documents of a folder; a document may be one record or an array of records."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(folder)


def issues_of(checks: list[DataFrame], most: int = 20) -> list[str]:
    """The first issues (subject, issue) that checks find, for a message."""
    found: list[str] = []
    for c in checks:
        found += [f"{r['issue']}: {r['subject']}" for r in c.select(F.col("subject").cast("string").alias("subject"), "issue").orderBy("subject").limit(most).collect()]
    return found[:most]


def write_checked(df: DataFrame, checks: list[DataFrame], path: str) -> None:
    """Writes JSON lines if no check has a row."""
    if found := issues_of(checks):
        raise Invalid("; ".join(found))
    write_lines(df, path)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of several places at which there is something."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        path = hadoop(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return p
    return None


def embedded_json(text: Column) -> Column:
    """The JSON in a text: a fenced block, else from the first to the last square bracket, else curly; null without any that parses."""
    tries = [F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)]
    return F.coalesce(*[F.when((t != "") & F.try_parse_json(t).isNotNull(), t) for t in tries])


def canonical(value: Column) -> Column:
    """JSON text with sorted keys and without white space, so equal values have equal text and hash."""
    return F.to_json(F.try_parse_json(value))


def structure_fingerprint(value: Column) -> Column:
    return F.concat(F.lit("structure:sha256:"), F.sha2(canonical(value), 256))
