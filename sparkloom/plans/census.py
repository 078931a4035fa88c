"""The census of repositories: inventory, what to read, and what every path says."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import census as C
from ..functions import paths as P
from ..sources import repos
from .shared import Base, define

FILES = Base("repo_files", repos.files, repos.FILES_SQL)


def inventory(df):
    """Adds the inventory's columns to (file_id, repo, path, text): name, ext, bytes, lines, hash, language, category, is_binary, large, content_analyzable, protected, reason."""
    named = df.withColumn("name", F.expr(C.spark_name())).withColumn("ext", F.expr(C.spark_ext()))
    seen = named.withColumn("textual", F.expr(C.textual_sql(True))).withColumn("reason", F.expr(C.ladder(C.REASONS, "", True)))
    kinds = seen.withColumn("category", F.expr(C.ladder(C.CATEGORIES, "source", True))).withColumn("language", C.language())
    bytes_ = F.octet_length("text").cast("long")
    lines = F.when(F.length("text") == 0, 0).otherwise(F.size(F.split("text", "\r?\n"))).cast("long")
    return kinds.select(
        "file_id", "repo", "path", "name", "ext", "text", bytes_.alias("bytes"), lines.alias("lines"), F.sha1("text").alias("hash"), "language", "category", (~F.col("textual")).alias("is_binary"), (bytes_ > C.LARGE).alias("large"),
        (F.col("textual") & (bytes_ <= C.LARGE) & (F.col("reason") == "")).alias("content_analyzable"), (F.col("reason") != "").alias("protected"), "reason",
    )


def inventory_sql() -> str:
    """The same, as the table inv of DuckDB SQL."""
    return f"{repos.FILES_SQL}, {inventory_ctes()}"


def inventory_ctes() -> str:
    """inv from a table repo_files."""
    return rf"""named AS (SELECT *, {C.NAME_SQL} AS name, {C.EXT_SQL} AS ext FROM repo_files),
  seen AS (SELECT *, {C.textual_sql(False)} AS textual, {C.ladder(C.REASONS, "", False)} AS reason FROM named),
  inv AS (SELECT file_id, repo, path, name, ext, text, strlen(text)::BIGINT AS bytes, CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split_regex(text, '\r?\n')) END::BIGINT AS lines, sha1(text) AS hash,
    {C.ladder(C.language_rules(), "Text", False)} AS language, {C.ladder(C.CATEGORIES, "source", False)} AS category, NOT textual AS is_binary, strlen(text) > {C.LARGE} AS large,
    textual AND strlen(text) <= {C.LARGE} AND reason = '' AS content_analyzable, reason <> '' AS protected, reason FROM seen)"""


INVENTORY = Base("inv", lambda s, d: inventory(repos.files(s, d)), inventory_sql())
SNIPPET, BUDGET, TOP = 2600, 180_000, 60

define("repo_inventory", [INVENTORY], "SELECT file_id, repo, path, bytes, lines, hash, language, category, is_binary, large, content_analyzable, protected, reason FROM inv", "Every file with its size, lines, hash, language, category and protection.")
define("repo_counts", [INVENTORY], "SELECT repo, count(*)::BIGINT AS files, count_if(protected)::BIGINT AS protected, count_if(content_analyzable)::BIGINT AS analyzable, sum(bytes)::BIGINT AS bytes, sum(lines)::BIGINT AS lines, count(DISTINCT language)::BIGINT AS languages FROM inv GROUP BY repo", "One row of metrics for each repository.")
define("repo_top_directories", [INVENTORY], "SELECT repo, CASE WHEN ~(path, '/') THEN regexp_extract(path, '^([^/]*)/', 1) ELSE '.' END AS directory, category, language, count(*)::BIGINT AS files FROM inv GROUP BY ALL", "Files by top directory, with both histograms in long form.")
SCORE = f"""(CASE WHEN category = 'manifest' THEN 100 ELSE 0 END + CASE WHEN ~(name, '(?i)readme') THEN 90 ELSE 0 END + CASE WHEN ~(path, '{C.ENTRY_LIKE}') THEN 60 ELSE 0 END + CASE category WHEN 'source' THEN 20 WHEN 'config' THEN 30 WHEN 'docs' THEN 30 ELSE 0 END
  + CASE WHEN lines > 20 AND lines < 800 THEN 10 WHEN lines >= 1200 THEN -20 ELSE 0 END)"""
KEY = f"""keyed AS (SELECT repo, file_id, path, score, reason, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path, file_id) AS place FROM
  (SELECT repo, file_id, path, {SCORE}::BIGINT AS score, {C.ladder(C.KEY_REASONS, "representative source", False).replace("regexp_matches(", "~(")} AS reason FROM inv) s WHERE score > 0)"""
define("repo_key_files", [INVENTORY], f"{KEY} SELECT repo, file_id, path, score, reason, place::BIGINT AS place FROM keyed WHERE place <= {TOP}", "The files of each repository to read first, a top-k report: manifests and readme files, then what looks like an entry, with the reason.")
define(
    "repo_snippets", [Base("sized", lambda s, d: inventory(repos.files(s, d)).where("content_analyzable AND category <> 'resource'").select("repo", "file_id", "path", F.least(F.length(C.sanitised(F.col("text"))), F.lit(SNIPPET)).cast("long").alias("chars")), inventory_sql() + f", sized AS (SELECT repo, file_id, path, least(length({C.sanitised_sql('text')}), {SNIPPET})::BIGINT AS chars FROM inv WHERE content_analyzable AND category <> 'resource')")],
    f"SELECT repo, file_id, chars, used FROM (SELECT repo, file_id, chars, coalesce(sum(chars) OVER (PARTITION BY repo ORDER BY path, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM sized) b WHERE used < {BUDGET}",
    "The redacted snippets that a budget of characters lets in, in order of path, with the characters before each; texts don't reach the exchange.",
)
define("repo_redacted", [Base("dirty", lambda s, d: repos.files(s, d).where(F.col("text").rlike(C.SECRET_LINE)).select("file_id", F.sha2(C.sanitised(F.col("text")), 256).alias("clean_hash")), f"{repos.FILES_SQL}, dirty AS (SELECT file_id, sha256({C.sanitised_sql('text')}) AS clean_hash FROM repo_files WHERE regexp_matches(text, '{C.SECRET_LINE}'))")], "SELECT file_id, clean_hash FROM dirty", "Texts with secrets, after the rest of each secret line is cut, as hashes.")

define("path_predicates", [FILES], "SELECT file_id, path, " + ", ".join(f"{p.sql('path')} AS {n}" for n, p in P.PREDICATES.items()) + " FROM repo_files", "What holds for every path.")
define("path_kinds", [FILES], "SELECT file_id, path, " + ", ".join(f"{p.sql('path')} AS {n}" for n, p in P.KINDS.items()) + " FROM repo_files", "The kind of every path under each ordered classification.")
define("path_ranks", [FILES], "SELECT file_id, path, " + ", ".join(f"{p.sql('path')} AS {n}" for n, p in P.RANKS.items()) + " FROM repo_files", "Ranks and confidences of every path as entry, root, layout and page.")
PARENT = "coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.')"
define(
    "path_names", [Base("said", lambda s, d: repos.files(s, d).select("file_id", "path", P.page_title(F.col("path")).alias("title"), P.top_group(F.col("path")).alias("top_group"), P.safe_id(F.col("path")).alias("safe_id")), f"{repos.FILES_SQL}, said AS (SELECT file_id, path, {P.page_title_sql('path')} AS title, {P.top_group_sql('path')} AS top_group, {P.safe_id_sql('path')} AS safe_id FROM repo_files)")],
    f"SELECT file_id, title, top_group, safe_id, {PARENT} AS parent, {P.entity_id_sql('path')} AS entity_id, 'module:' || path AS module_id, 'evidence:file:' || path AS evidence_ref FROM said", "Titles, groups and ids that follow from paths.",
)
define("page_candidates", [FILES], f"""SELECT repo, path, {P.RANKS['page_rank'].sql('path')} AS rank, {P.RANKS['page_confidence'].sql('path')} AS confidence, row_number() OVER (PARTITION BY repo ORDER BY {P.RANKS['page_rank'].sql('path')} DESC, path)::BIGINT AS place
  FROM (SELECT DISTINCT repo, path FROM repo_files WHERE {P.PREDICATES['page_candidate'].sql('path')}) p""", "Pages of each repository by rank.")
define("layout_candidates", [FILES], f"""SELECT repo, path, {P.RANKS['layout_rank'].sql('path')} AS rank, {P.RANKS['layout_confidence'].sql('path')} AS confidence, row_number() OVER (PARTITION BY repo ORDER BY {P.RANKS['layout_rank'].sql('path')} DESC, path)::BIGINT AS place
  FROM (SELECT DISTINCT repo, path FROM repo_files WHERE {P.PREDICATES['layout_candidate'].sql('path')}) p""", "Layouts of each repository by rank.")
define("surface_candidates", [FILES], f"""paths AS (SELECT DISTINCT repo, path FROM repo_files), s AS (
  SELECT repo, path, 'build-deploy' AS surface, {P.KINDS['build_kind'].sql('path')} AS kind FROM paths WHERE {P.PREDICATES['build_deploy'].sql('path')}
  UNION ALL SELECT repo, path, 'test-quality', {P.KINDS['test_kind'].sql('path')} FROM paths WHERE {P.PREDICATES['test_file'].sql('path')} OR {P.PREDICATES['quality_config'].sql('path')}
  UNION ALL SELECT repo, path, 'api-client', {P.KINDS['api_client_kind'].sql('path')} FROM paths WHERE {P.PREDICATES['api_module'].sql('path')} AND {P.PREDICATES['source_file'].sql('path')}
  UNION ALL SELECT repo, path, 'auth', {P.KINDS['auth_kind'].sql('path')} FROM paths WHERE {P.PREDICATES['source_file'].sql('path')} AND ~(path, '(?i)guard|permission|rbac|token|session|auth')
  UNION ALL SELECT repo, path, 'route-root', {P.KINDS['route_kind'].sql('path')} FROM paths WHERE {P.PREDICATES['route_root'].sql('path')})
  SELECT repo, surface, kind, count(*)::BIGINT AS paths, @set(path) AS path_list FROM s GROUP BY repo, surface, kind""", "Candidate surfaces of each repository (build, tests, API clients, authorisation, routes) with their kinds and paths.")
