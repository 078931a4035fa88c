"""Inventories of files, rule scans over their lines, and facts of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query
from ..sources.tables import FILES_SQL, files, table
from . import census

MAX_FILES = 16_000


def inventory(df: DataFrame) -> DataFrame:
    """The inventory columns of (file_id, path, text)."""
    seen = census.inventory(df.withColumn("repo", F.lit("")))
    return seen.select("file_id", "path", "bytes", "lines", "hash", "language", "category", F.col("is_binary").alias("binary"), "large", "content_analyzable")


INVENTORY_SQL = f"""{FILES_SQL}, repo_files AS (SELECT *, '' AS repo FROM files), {census.inventory_ctes()},
  inventory AS (SELECT file_id, path, bytes, lines, hash, language, category, is_binary AS "binary", large, content_analyzable FROM inv)"""


@query(f"WITH {INVENTORY_SQL} SELECT * FROM inventory")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(files(spark, sf_dir))


@query(f"WITH {INVENTORY_SQL} SELECT language, count(*) AS files, sum(bytes)::BIGINT AS bytes, sum(lines)::BIGINT AS lines FROM inventory GROUP BY 1")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(files(spark, sf_dir)).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"))


@query(f"WITH {INVENTORY_SQL} SELECT {X.directory_sql('path')} AS directory, category, language, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM inventory GROUP BY ALL")
def directory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(files(spark, sf_dir)).groupBy(X.directory(F.col("path")).alias("directory"), "category", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


@query(f"SELECT count(*) AS found, least(count(*), {MAX_FILES})::BIGINT AS kept, count(*) > {MAX_FILES} AS truncated FROM (SELECT doc_id FROM documents UNION ALL SELECT page_id FROM pages)")
def inventory_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan's file limit would keep. Counted from the files' footers."""
    n = F.count(F.lit(1))
    return files(spark, sf_dir).agg(n.alias("found"), F.least(n, F.lit(MAX_FILES)).cast("long").alias("kept"), (n > MAX_FILES).alias("truncated"))


@query("SELECT lower(tag) AS tag, count(*) AS refs, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9-]*)', 1)) AS tag FROM pages) GROUP BY 1")
def html_component_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9-]*)"), 1)).alias("tag"))
    per_page = tags.groupBy(F.lower("tag").alias("tag"), "page_id").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("tag").agg(F.sum("n").alias("refs"), F.count(F.lit(1)).alias("pages"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (page_id, host, href) with how often each occurs."""
    found = table(spark, sf_dir, "pages").select("page_id", X.host(F.col("url")).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return found.groupBy("page_id", "host", "href").agg(F.count(F.lit(1)).alias("n"))


LINKS_SQL = f"""links AS (SELECT page_id, host, href, count(*) AS n FROM (SELECT page_id, {X.host_sql("url")} AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL)"""
KIND_SQL = "CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'external' WHEN starts_with(href, '/') THEN 'root' WHEN starts_with(href, '#') THEN 'fragment' ELSE 'relative' END"


@query(f"WITH {LINKS_SQL} SELECT page_id, href, {KIND_SQL} AS kind, n FROM links")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.col("href")
    kind = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "external").when(F.startswith(href, F.lit("/")), "root").when(F.startswith(href, F.lit("#")), "fragment").otherwise("relative")
    return links(spark, sf_dir).select("page_id", "href", kind.alias("kind"), "n")


@query(f"SELECT {X.host_sql('url')} AS host, count(*) AS pages, count(DISTINCT {X.normal_path_sql('url')}) AS paths FROM pages GROUP BY 1")
def external_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_path = table(spark, sf_dir, "pages").groupBy(X.host(F.col("url")).alias("host"), X.normal_path(F.col("url")).alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return per_path.groupBy("host").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("paths"))


@query(f"SELECT page_id, {X.normal_path_sql('url')} AS path FROM pages")
def path_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.normal_path(F.col("url")).alias("path"))


@query("SELECT page_id, lower(to_base(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619::BIGINT) & 4294967295::BIGINT), 36)) AS token FROM pages")
def fnv_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.fnv1a32(F.col("url")).alias("token"))


@query(f"""WITH {LINKS_SQL}, known AS (SELECT DISTINCT {X.normal_path_sql("url")} AS path FROM pages UNION SELECT DISTINCT host FROM links),
  tried AS (SELECT page_id, href, {X.normal_path_sql("host || '/' || href")} AS path, 1 AS rank FROM links UNION ALL SELECT page_id, href, lower({X.normal_path_sql("host || '/' || href")}), 2 FROM links UNION ALL SELECT page_id, href, host, 3 FROM links)
  SELECT page_id, href, arg_min(path, rank) AS resolved, min(rank) AS rank FROM tried JOIN known USING (path) GROUP BY ALL""")
def ranked_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link resolved to the first of its ranked candidates that exists: the path, the path in lower case, the host."""
    own = links(spark, sf_dir)
    full = X.normal_path(F.concat("host", F.lit("/"), "href"))
    tried = own.select("page_id", "href", F.posexplode(F.array(full, F.lower(full), F.col("host"))).alias("pos", "path"))
    pages = table(spark, sf_dir, "pages")
    known = pages.select(X.normal_path(F.col("url")).alias("path")).union(own.select("host")).distinct()
    hit = tried.join(known, "path")
    return hit.groupBy("page_id", "href").agg(F.min_by("path", "pos").alias("resolved"), (F.min("pos") + 1).cast("int").alias("rank"))


@query(f"SELECT family, count(*) AS pages, count(DISTINCT host) AS hosts FROM (SELECT {X.host_sql('url')} AS host, regexp_replace(regexp_replace({X.normal_path_sql('url')}, '^[^/]*', ''), '/[0-9]+', '/:id', 'g') AS family FROM pages) GROUP BY 1")
def route_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.regexp_replace(F.regexp_replace(X.normal_path(F.col("url")), "^[^/]*", ""), "/[0-9]+", "/:id")
    per_host = table(spark, sf_dir, "pages").groupBy(family.alias("family"), X.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return per_host.groupBy("family").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("hosts"))


def snapshot(df: DataFrame, levels: tuple[int, ...] = (5, 2, 0)) -> DataFrame:
    """One row (files, snapshot_id) for (path, hash): a tree of hashes, so no string grows beyond a bucket of it."""
    node = df.select(F.sha2("path", 256).alias("key"), F.sha2(F.concat("path", F.lit(":"), "hash"), 256).alias("h"), F.lit(1).cast("long").alias("n"))
    for k in levels:
        node = node.groupBy(F.substring("key", 1, k).alias("key")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.sum("n").alias("n"))
    return node.select(F.col("n").alias("files"), F.col("h").alias("snapshot_id"))


def snapshot_sql(source: str, levels: tuple[int, ...] = (5, 2, 0)) -> str:
    node = f"SELECT sha256(path) AS key, sha256(path || ':' || hash) AS h, 1 AS n FROM {source}"
    for k in levels:
        node = f"SELECT substr(key, 1, {k}) AS key, sha256(string_agg(h, '' ORDER BY h)) AS h, sum(n) AS n FROM ({node}) GROUP BY 1"
    return f"SELECT n::BIGINT AS files, h AS snapshot_id FROM ({node})"


@query(f"WITH {INVENTORY_SQL} {snapshot_sql('inventory')}")
def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(inventory(files(spark, sf_dir)).select("path", "hash"))
