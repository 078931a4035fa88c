"""Materialised views over the census, the program graph and the catalogs: maps, atlas, summaries, change sets, keys and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import graph
from .catalogs import CLAIMS, LABELS, QUESTIONS, SEMANTICS, ZONED
from .census import FILES, INVENTORY
from .profile import DEPS, MANIFESTS
from .program import BOTH, DEPEND, MARKED, OWNED, SIZES, over, own_text, paired, views
from .scans import CODE_FACTS, HITS, WRITTEN_FACTS
from .shared import define, spoken

KIND = r"CASE WHEN ~(path, '(?i)[.](?:test|spec)[.]|(^|/)(?:__tests__|tests?)/') THEN 'test' WHEN ~(path, '(?i)(^|/)(?:pages|views|screens)/') THEN 'page' WHEN ~(path, '(?i)(^|/)components?/') THEN 'component' WHEN ~(path, '(?i)(^|/)(?:api|services?)/') THEN 'api' WHEN ~(path, '(?i)(^|/)(?:store|state)/') THEN 'state' WHEN ~(path, '(?i)(^|/)(?:router|routes)/') THEN 'route' WHEN ~(path, '(?i)[.]vue$') THEN 'view' WHEN category = 'config' THEN 'config' ELSE 'source' END"
define("atlas_files", [INVENTORY, CODE_FACTS, HITS, LABELS], f"""d AS (SELECT file_id, count(*) AS n FROM hits GROUP BY file_id), r AS (SELECT file_id, count(*) AS n FROM facts WHERE fact = 'route' GROUP BY file_id), s AS (SELECT file_id, max(quality) AS quality FROM entries GROUP BY file_id)
  SELECT i.file_id, i.repo, i.path, i.language, {KIND} AS kind, coalesce(d.n, 0)::BIGINT AS diagnostics, coalesce(r.n, 0)::BIGINT AS routes, s.quality IS NOT NULL AS has_semantics FROM inv i LEFT JOIN d ON i.file_id = d.file_id LEFT JOIN r ON i.file_id = r.file_id LEFT JOIN s ON i.file_id = s.file_id""", "The atlas's file model: inventory with diagnostics, routes and semantics.")
LIFTED = f"{own_text(OWNED)}, lifted AS (SELECT a.owner AS src, b.owner AS dst, e.type, count(*) AS n FROM own e JOIN owners a ON e.src = a.node_id JOIN owners b ON e.dst = b.node_id WHERE a.owner <> b.owner GROUP BY a.owner, b.owner, e.type)"


def atlas_file_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that only a test joins pass as a stream; of the others a test's edge is one of the types."""
    views(spark, sf_dir, "nodes", "own", "stems")
    graph.checkpointed(spark.sql(f"WITH {spoken(LIFTED, True)} SELECT * FROM lifted")).createOrReplaceTempView("lifted")
    marked = graph.checkpointed(spark.sql(f"WITH {MARKED} SELECT src, dst FROM marked"))
    marked.createOrReplaceTempView("marked")
    best = spark.sql("SELECT src, dst, max_by(type, lpad(CAST(n AS STRING), 12, '0') || type) AS primary_type, sum(n) AS weight FROM (SELECT src, dst, type, n FROM lifted UNION ALL SELECT src, dst, 'tests', 1L FROM marked) l GROUP BY src, dst")
    return best.union(paired(spark.table("stems"), marked).selectExpr("src", "dst", "'tests'", "1L"))


define("atlas_file_graph", BOTH, f"""{OWNED}, lifted AS (SELECT a.owner AS src, b.owner AS dst, e.type, count(*) AS n FROM edges e JOIN owners a ON e.src = a.node_id JOIN owners b ON e.dst = b.node_id WHERE a.owner <> b.owner GROUP BY a.owner, b.owner, e.type), best AS (SELECT src, dst, max_by(type, lpad(CAST(n AS STRING), 12, '0') || type) AS primary_type, sum(n) AS weight FROM lifted GROUP BY src, dst)
  SELECT src, dst, primary_type, weight::BIGINT AS weight FROM best""", "Edges between files with their weight and most frequent type.", atlas_file_graph)
define("atlas_degrees", BOTH, f"""{OWNED}, lifted AS (SELECT DISTINCT a.owner AS src, b.owner AS dst FROM edges e JOIN owners a ON e.src = a.node_id JOIN owners b ON e.dst = b.node_id WHERE a.owner <> b.owner), sides AS (SELECT src AS node, 1 AS outgoing, 0 AS incoming FROM lifted UNION ALL SELECT dst, 0, 1 FROM lifted) SELECT node, sum(outgoing)::BIGINT AS outgoing, sum(incoming)::BIGINT AS incoming FROM sides GROUP BY node""", "In and out degrees of files.", over(f"""{LIFTED}, {SIZES}, {MARKED}, pairs AS (SELECT DISTINCT src, dst FROM lifted), rest AS (SELECT p.src, p.dst FROM pairs p ANTI JOIN marked k ON p.src = k.src AND p.dst = k.dst), sides AS (SELECT src AS node, 1L AS outgoing, 0L AS incoming FROM rest UNION ALL SELECT dst, 0L, 1L FROM rest
  UNION ALL SELECT s.node_id, CASE WHEN s.is_test THEN z.tested ELSE 0L END, CASE WHEN s.is_test THEN 0L ELSE z.tests END FROM stems s JOIN sizes z ON s.repo = z.repo AND s.stem = z.stem AND z.tests > 0 AND z.tested > 0) SELECT node, sum(outgoing)::BIGINT AS outgoing, sum(incoming)::BIGINT AS incoming FROM sides GROUP BY node""", "nodes", "own", "stems"))
define("atlas_groups", [INVENTORY], f"SELECT repo, CASE WHEN NOT ~(path, '/') THEN '.' WHEN @starts(path, 'src/') THEN regexp_extract(path, '^(src(?:/[^/]+){{0,2}})/', 1) ELSE regexp_extract(path, '^([^/]+)/', 1) END AS top_group, {KIND} AS kind, count(*)::BIGINT AS files, sum(lines)::BIGINT AS lines FROM inv GROUP BY ALL", "Files by group of directories and kind.")
define("atlas_stages", [INVENTORY, CODE_FACTS, LABELS], """totals AS (SELECT repo, count(*) AS files FROM inv GROUP BY repo), f AS (SELECT repo, count(DISTINCT file_id) AS n FROM facts GROUP BY repo), e AS (SELECT i.repo, count(DISTINCT i.file_id) AS n FROM inv i SEMI JOIN entries e ON i.file_id = e.file_id GROUP BY i.repo)
  SELECT t.repo, 'census' AS stage, t.files::BIGINT AS done, t.files::BIGINT AS total FROM totals t UNION ALL SELECT t.repo, 'facts', coalesce(f.n, 0)::BIGINT, t.files::BIGINT FROM totals t LEFT JOIN f ON t.repo = f.repo UNION ALL SELECT t.repo, 'semantics', coalesce(e.n, 0)::BIGINT, t.files::BIGINT FROM totals t LEFT JOIN e ON t.repo = e.repo""", "How far each stage has come over the files of each repository.")
BOUNDARY = f"""{ZONED}, lifted AS (SELECT DISTINCT e.repo, a.source_path AS from_path, b.source_path AS to_path FROM edges e JOIN nodes a ON e.src = a.node_id JOIN nodes b ON e.dst = b.node_id WHERE a.source_path IS NOT NULL AND b.source_path IS NOT NULL AND a.source_path <> b.source_path), zones_of AS (SELECT DISTINCT repo, path, zone FROM zoned),
  crossing AS (SELECT l.repo, l.from_path, l.to_path, x.zone AS from_zone, y.zone AS to_zone FROM lifted l JOIN zones_of x ON l.repo = x.repo AND l.from_path = x.path JOIN zones_of y ON l.repo = y.repo AND l.to_path = y.path WHERE x.zone <> y.zone)"""
#: The same without edges of tests; placed: what these join, with its zone.
OWN_BOUNDARY = f"{own_text(BOUNDARY)}, placed AS (SELECT s.repo, s.stem, s.path, s.is_test, z.zone FROM stems s JOIN zones_of z ON s.repo = z.repo AND s.path = z.path)"
define("domain_boundary_files", [*BOTH, FILES], f"""{BOUNDARY}, sides AS (SELECT repo, from_zone AS zone, from_path AS path, to_zone AS other, true AS outbound FROM crossing UNION ALL SELECT repo, to_zone, to_path, from_zone, false FROM crossing)
  SELECT repo, zone, path, CASE WHEN bool_or(outbound) AND bool_or(NOT outbound) THEN 'bidirectional' WHEN bool_or(outbound) THEN 'outbound' ELSE 'inbound' END AS direction, @set(other) AS connected_zones FROM sides GROUP BY repo, zone, path""", "Files whose relations cross a zone's boundary: in which direction, and with which zones.", over(f"""{OWN_BOUNDARY}, held AS (SELECT DISTINCT repo, stem, is_test, zone FROM placed), sides AS (SELECT repo, from_zone AS zone, from_path AS path, to_zone AS other, true AS outbound FROM crossing UNION ALL SELECT repo, to_zone, to_path, from_zone, false FROM crossing
  UNION ALL SELECT p.repo, p.zone, p.path, h.zone, p.is_test FROM placed p JOIN held h ON p.repo = h.repo AND p.stem = h.stem AND p.is_test <> h.is_test AND p.zone <> h.zone)
  SELECT repo, zone, path, CASE WHEN bool_or(outbound) AND bool_or(NOT outbound) THEN 'bidirectional' WHEN bool_or(outbound) THEN 'outbound' ELSE 'inbound' END AS direction, @set(other) AS connected_zones FROM sides GROUP BY repo, zone, path""", "nodes", "own", "stems"))
define("domain_relations", [*BOTH, FILES], f"{BOUNDARY} SELECT repo, from_zone, to_zone, count(*)::BIGINT AS relations FROM crossing GROUP BY repo, from_zone, to_zone", "Relations between zones.", over(f"""{OWN_BOUNDARY}, held AS (SELECT repo, stem, zone, count_if(is_test) AS tests, count_if(NOT is_test) AS tested FROM placed GROUP BY repo, stem, zone), tested AS (SELECT c.repo, c.from_path, c.to_path FROM crossing c JOIN stems t ON c.repo = t.repo AND c.from_path = t.path AND t.is_test JOIN stems m ON c.repo = m.repo AND c.to_path = m.path AND NOT m.is_test AND m.stem = t.stem),
  rest AS (SELECT c.repo, c.from_zone, c.to_zone FROM crossing c ANTI JOIN tested t ON c.repo = t.repo AND c.from_path = t.from_path AND c.to_path = t.to_path), counted AS (SELECT repo, from_zone, to_zone, count(*) AS n FROM rest GROUP BY repo, from_zone, to_zone UNION ALL SELECT a.repo, a.zone, b.zone, a.tests * b.tested FROM held a JOIN held b ON a.repo = b.repo AND a.stem = b.stem AND a.zone <> b.zone AND a.tests > 0 AND b.tested > 0)
  SELECT repo, from_zone, to_zone, sum(n)::BIGINT AS relations FROM counted GROUP BY repo, from_zone, to_zone""", "nodes", "own", "stems"))
define("domain_summaries", [FILES, LABELS], f"""{SEMANTICS} SELECT z.repo, z.zone, count(DISTINCT z.file_id)::BIGINT AS files, count(s.file_id)::BIGINT AS described, count_if(s.status = 'accepted')::BIGINT AS accepted, CASE WHEN count(s.file_id) = 0 THEN 'missing' WHEN count_if(s.status = 'accepted') * 2 >= count(s.file_id) THEN 'draft' ELSE 'needs-evidence' END AS status FROM zoned z LEFT JOIN semantics s ON z.file_id = s.file_id GROUP BY z.repo, z.zone""", "Domain summaries of each zone: what is described and accepted.")
define("domain_summary_issues", [FILES, LABELS], f"""{SEMANTICS}, s AS (SELECT z.repo, z.zone, count(DISTINCT z.file_id) AS files, count(s.file_id) AS described FROM zoned z LEFT JOIN semantics s ON z.file_id = s.file_id GROUP BY z.repo, z.zone) SELECT repo, zone, 'ZONE_NOT_COVERED' AS issue FROM s WHERE described = 0 UNION ALL SELECT repo, zone, 'ROLES_EXCEED_FILES' FROM s WHERE described > files""", "Zones without a summary, or with more roles than files.")
APPLICATION_MAP_TEXT = f"""owned AS (SELECT node_id FROM nodes WHERE kind IN ('layout', 'module', 'page', 'route', 'endpoint', 'state', 'external-package')) SELECT 'entity' AS part, kind, count(*)::BIGINT AS n FROM nodes n SEMI JOIN owned o ON n.node_id = o.node_id GROUP BY kind UNION ALL SELECT 'relation', type, count(*)::BIGINT FROM edges WHERE {DEPEND} GROUP BY type"""
define("application_map", BOTH, APPLICATION_MAP_TEXT, "The application map's entities and relations by kind.", over(own_text(APPLICATION_MAP_TEXT), "nodes", "own"))
APPLICATION_MAP_ISSUES_TEXT = f"SELECT e.edge_id, 'RELATION_END_UNKNOWN' AS issue FROM edges e ANTI JOIN nodes n ON e.dst = n.node_id WHERE {DEPEND}"
define("application_map_issues", BOTH, APPLICATION_MAP_ISSUES_TEXT, "Relations of the application map that lead nowhere.", over(own_text(APPLICATION_MAP_ISSUES_TEXT), "nodes", "own"))
define("experience_map", [FILES, LABELS], f"{CLAIMS} SELECT predicate, derivation, status, count(*)::BIGINT AS claims, round(avg(confidence), 6) AS confidence FROM claims WHERE predicate <> 'has-role' GROUP BY predicate, derivation, status", "Claims of the experience map.")
define("state_surfaces", [CODE_FACTS], "s AS (SELECT repo, name AS system, path FROM facts WHERE fact IN ('state', 'mutation') GROUP BY repo, name, path) SELECT repo, system, path, count(*) OVER (PARTITION BY repo, system)::BIGINT AS paths FROM s", "Surfaces of state: each system with the paths that touch it.")
define("api_surfaces", [CODE_FACTS], "SELECT repo, name AS url, count(DISTINCT path)::BIGINT AS callers, min(path) AS first_caller FROM facts WHERE fact = 'request' GROUP BY repo, name", "Surfaces of APIs: each address with its callers.")
define("auth_surfaces", [CODE_FACTS], "SELECT repo, path, @set(name) AS guards FROM facts WHERE fact = 'guard' GROUP BY repo, path", "Surfaces of authorisation.")
define("change_sets", [*BOTH, FILES], f"""changed AS (SELECT DISTINCT repo, path FROM repo_files WHERE file_id % 10 = 0), touched AS (SELECT n.repo, n.node_id FROM nodes n SEMI JOIN changed c ON n.repo = c.repo AND n.source_path = c.path), near AS (SELECT t.repo, t.node_id AS subject, e.src AS affected, e.type FROM touched t JOIN edges e ON e.dst = t.node_id)
  SELECT t.repo, t.node_id AS subject, count(DISTINCT n.affected)::BIGINT AS affected, coalesce(@set(n.type), '') AS types FROM touched t LEFT JOIN near n ON t.node_id = n.subject GROUP BY t.repo, t.node_id""", "What a change of every tenth file touches, and what depends on that directly.", over(f"""changed AS (SELECT DISTINCT repo, path FROM repo_files WHERE file_id % 10 = 0), touched AS (SELECT n.repo, n.node_id FROM nodes n SEMI JOIN changed c ON n.repo = c.repo AND n.source_path = c.path), lifted AS (SELECT src, dst FROM own), {SIZES}, {MARKED},
  near AS (SELECT t.node_id AS subject, CASE WHEN k.src IS NULL THEN e.src END AS affected, e.type, 0L AS tests FROM touched t JOIN own e ON e.dst = t.node_id LEFT JOIN marked k ON e.src = k.src AND e.dst = k.dst UNION ALL SELECT s.node_id, NULL, 'tests', z.tests FROM stems s JOIN sizes z ON s.repo = z.repo AND s.stem = z.stem AND z.tests > 0 WHERE NOT s.is_test)
  SELECT t.repo, t.node_id AS subject, (count(DISTINCT n.affected) + coalesce(max(n.tests), 0))::BIGINT AS affected, coalesce(@set(n.type), '') AS types FROM touched t LEFT JOIN near n ON t.node_id = n.subject GROUP BY t.repo, t.node_id""", "nodes", "own", "stems"))
define("impacted_claims", [FILES, LABELS], f"{CLAIMS}, changed AS (SELECT DISTINCT file_id FROM repo_files WHERE file_id % 10 = 0) SELECT c.claim_id, c.subject, c.predicate FROM claims c SEMI JOIN changed h ON c.file_id = h.file_id", "Claims whose evidence changed.")
KEY = """parts AS (SELECT repo, 'inventory' AS part, @sha(path || ':' || hash) AS h FROM inv UNION ALL SELECT repo, 'dependencies', @sha(name || ':' || version) FROM deps UNION ALL SELECT repo, 'manifests', @sha(type || ':' || path) FROM manifests),
  keyed AS (SELECT repo, part, @sha(@set(h)) AS part_hash, count(*) AS rows FROM parts GROUP BY repo, part)"""
define("projection_manifest", [INVENTORY, DEPS, MANIFESTS], f"{KEY} SELECT repo, part, part_hash, rows::BIGINT AS rows FROM keyed", "The parts of each repository's projection key with their hashes.")
define("projection_keys", [INVENTORY, DEPS, MANIFESTS], f"{KEY} SELECT repo, @sha(@set(part || '=' || part_hash)) AS projection_key, count(*)::BIGINT AS parts FROM keyed GROUP BY repo", "One key for each repository that changes with any of its inputs.")
define("stale_views", [INVENTORY, DEPS, MANIFESTS], f"{KEY}, built AS (SELECT repo, part, CASE WHEN repo IN ('repo3', 'repo7') AND part = 'inventory' THEN @sha('before') ELSE part_hash END AS part_hash FROM keyed) SELECT k.repo, k.part, 'PROJECTION_STALE' AS issue FROM keyed k LEFT JOIN built b ON k.repo = b.repo AND k.part = b.part WHERE b.part_hash IS NULL OR b.part_hash <> k.part_hash", "Views whose inputs changed since they were built (two repositories whose manifest is planted as older).")
PACKAGE_GATE = f"""{QUESTIONS}, dangling AS (SELECT count(*) AS n FROM edges e ANTI JOIN nodes n ON e.dst = n.node_id), missing AS (SELECT count(*) AS n FROM repo_files f ANTI JOIN entries e ON f.file_id = e.file_id), critical AS (SELECT count(*) AS n FROM asked a LEFT JOIN answered b ON a.question_id = b.question_id WHERE a.critical AND coalesce(b.status, '') <> 'resolved')
  SELECT 'graph-references' AS gate, n::BIGINT AS issues, n = 0 AS passed FROM dangling UNION ALL SELECT 'semantic-coverage', n::BIGINT, n = 0 FROM missing UNION ALL SELECT 'critical-questions', n::BIGINT, n = 0 FROM critical"""
define("package_gate", [*BOTH, FILES, LABELS], PACKAGE_GATE, "The gates that a package has to pass, with the issues at each.", over(own_text(PACKAGE_GATE), "nodes", "own", bases=(LABELS,)))
define("lineage", [INVENTORY, CODE_FACTS], "SELECT i.repo, 'inventory' AS artefact, count(*)::BIGINT AS rows, min(i.hash) AS first_hash FROM inv i GROUP BY i.repo UNION ALL SELECT f.repo, 'facts-' || f.fact, count(*)::BIGINT, min(f.name) FROM facts f GROUP BY f.repo, f.fact", "Where each artefact of a repository comes from: its rows and first key.")
define("wiki_tables", [INVENTORY, CODE_FACTS], """l AS (SELECT repo, 'language' AS section, language AS name, count(*) AS n FROM inv GROUP BY repo, language), p AS (SELECT repo, 'package' AS section, name, count(*) AS n FROM facts WHERE fact = 'import' AND NOT ~(name, '^([.]|/|@/|~/)') GROUP BY repo, name), ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, section ORDER BY n DESC, name) AS place FROM (SELECT * FROM l UNION ALL SELECT * FROM p) u)
  SELECT repo, section, name, n::BIGINT AS n, place::BIGINT AS place FROM ranked WHERE place <= 30""", "The tables of a repository's page: its 30 most frequent languages and packages, a report.")
define("unknowns", [INVENTORY, WRITTEN_FACTS], """t AS (SELECT DISTINCT repo FROM inv) SELECT repo, 'no-routes' AS unknown FROM t ANTI JOIN (SELECT repo AS r FROM facts WHERE fact = 'route') x ON t.repo = x.r UNION ALL SELECT repo, 'no-imports' FROM t ANTI JOIN (SELECT repo AS r FROM facts WHERE fact = 'import') x ON t.repo = x.r UNION ALL SELECT repo, 'no-tests' FROM t ANTI JOIN (SELECT repo AS r FROM facts WHERE fact = 'wiring') x ON t.repo = x.r""", "What isn't known of a repository, as nothing was found.")
