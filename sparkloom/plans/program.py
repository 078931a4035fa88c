"""The program graph: typed nodes and edges from the facts of files, its constraints, and views of it.

Ids hold the repository, the kind and what names the thing, so equal facts of several lines are one node or edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import graph
from ..registry import query
from ..sources import repos
from . import scans
from .census import FILES
from .profile import DEPS
from .scans import CODE_FACTS, IMPORTS, PATHS, RESOLVED, TRIED
from .shared import STARTS, Base, define, is_cte, spoken, tables

NEEDS = [CODE_FACTS, IMPORTS, TRIED, PATHS, FILES, DEPS]
TEST, SOURCE = P.PREDICATES["test_file"].sql("path"), P.PREDICATES["source_file"].sql("path")
STEM = "regexp_extract(path, '([^/.]+)[^/]*$', 1)"
NODES = f"""{RESOLVED}, modules AS (SELECT DISTINCT repo, path, CASE WHEN {TEST} THEN 'test' WHEN {P.PREDICATES['page_candidate'].sql('path')} THEN 'page' WHEN {P.PREDICATES['layout_candidate'].sql('path')} THEN 'layout' WHEN {SOURCE} OR ~(path, '[.](?:java|py|go|rs|svelte)$') THEN 'module' WHEN {P.PREDICATES['build_deploy'].sql('path')} THEN 'build' WHEN {P.PREDICATES['quality_config'].sql('path')} THEN 'config' ELSE 'resource' END AS kind, 'module:' || repo || ':' || path AS node_id FROM repo_files),
  bound AS (SELECT i.repo, i.path, i.name, r.target, CASE WHEN r.target IS NOT NULL THEN 'file' WHEN ~(i.name, '^([.]|/|@/|~/)') THEN 'unresolved' ELSE 'external' END AS resolution FROM imports i LEFT JOIN resolved r ON i.repo = r.repo AND i.path = r.path AND i.name = r.name),
  packages AS (SELECT DISTINCT repo, CASE WHEN @starts(name, '@') THEN coalesce(nullif(regexp_extract(name, '^(@[^/]+/[^/]+)', 1), ''), name) ELSE regexp_extract(name, '^([^/]+)', 1) END AS name FROM (SELECT repo, name FROM bound WHERE resolution = 'external' UNION ALL SELECT repo, name FROM deps) p),
  nodes AS (SELECT repo, node_id, kind, path AS label, path AS source_path, 1.0::DOUBLE AS confidence FROM modules
    UNION ALL SELECT repo, 'package:' || repo || ':' || name, 'external-package', name, NULL, 1.0::DOUBLE FROM packages
    UNION ALL SELECT DISTINCT repo, 'unresolved:' || repo || ':' || path || ':' || name, 'unresolved-module', name, NULL, 0.65::DOUBLE FROM bound WHERE resolution = 'unresolved'
    UNION ALL SELECT DISTINCT repo, fact || ':' || repo || ':' || path || ':' || name, fact, name, path, 0.7::DOUBLE FROM facts WHERE fact IN ('symbol', 'state')
    UNION ALL SELECT DISTINCT repo, 'component:' || repo || ':' || name, 'component-reference', name, NULL, 0.7::DOUBLE FROM facts WHERE fact = 'component'
    UNION ALL SELECT DISTINCT repo, 'route:' || repo || ':' || name, 'route', name, NULL, 0.7::DOUBLE FROM facts WHERE fact IN ('route', 'navigation')
    UNION ALL SELECT DISTINCT repo, 'endpoint:' || repo || ':' || name, 'endpoint', name, NULL, 0.7::DOUBLE FROM facts WHERE fact = 'request')"""
EDGES = f"""{NODES}, symbols AS (SELECT DISTINCT repo, path, name FROM facts WHERE fact = 'symbol'), global_names AS (SELECT repo, name, min(path) AS path, count(*) AS n FROM symbols GROUP BY repo, name),
  stems AS (SELECT repo, path, kind, lower({STEM}) AS stem FROM modules),
  ends AS (SELECT repo, 'module:' || repo || ':' || path AS src, 'symbol:' || repo || ':' || path || ':' || name AS dst, 'declares' AS type, 1.0::DOUBLE AS confidence FROM symbols
    UNION ALL SELECT DISTINCT f.repo, 'module:' || f.repo || ':' || f.path, 'symbol:' || f.repo || ':' || f.path || ':' || f.name, 'exports', 0.98::DOUBLE FROM facts f JOIN symbols s ON f.repo = s.repo AND f.path = s.path AND f.name = s.name WHERE f.fact = 'export'
    UNION ALL SELECT repo, 'module:' || repo || ':' || path, 'module:' || repo || ':' || target, 'imports', 0.98::DOUBLE FROM bound WHERE resolution = 'file'
    UNION ALL SELECT DISTINCT repo, 'module:' || repo || ':' || path, 'package:' || repo || ':' || CASE WHEN @starts(name, '@') THEN coalesce(nullif(regexp_extract(name, '^(@[^/]+/[^/]+)', 1), ''), name) ELSE regexp_extract(name, '^([^/]+)', 1) END, 'imports', 0.98::DOUBLE FROM bound WHERE resolution = 'external'
    UNION ALL SELECT repo, 'module:' || repo || ':' || path, 'unresolved:' || repo || ':' || path || ':' || name, 'imports', 0.65::DOUBLE FROM bound WHERE resolution = 'unresolved'
    UNION ALL SELECT DISTINCT repo, 'module:' || repo || ':' || path, 'component:' || repo || ':' || name, 'renders-component', 0.7::DOUBLE FROM facts WHERE fact = 'component'
    UNION ALL SELECT DISTINCT f.repo, 'component:' || f.repo || ':' || f.name, 'symbol:' || g.repo || ':' || g.path || ':' || g.name, 'composes', 0.98::DOUBLE FROM facts f JOIN global_names g ON f.repo = g.repo AND f.name = g.name AND g.n = 1 WHERE f.fact = 'component'
    UNION ALL SELECT DISTINCT repo, 'module:' || repo || ':' || path, 'route:' || repo || ':' || name, 'declares-route', 0.7::DOUBLE FROM facts WHERE fact = 'route'
    UNION ALL SELECT DISTINCT repo, 'module:' || repo || ':' || path, 'route:' || repo || ':' || name, 'navigates-to', 0.7::DOUBLE FROM facts WHERE fact = 'navigation'
    UNION ALL SELECT DISTINCT repo, 'module:' || repo || ':' || path, 'endpoint:' || repo || ':' || name, 'requests', 0.7::DOUBLE FROM facts WHERE fact = 'request'
    UNION ALL SELECT DISTINCT repo, 'module:' || repo || ':' || path, 'state:' || repo || ':' || path || ':' || name, 'uses-state', 0.7::DOUBLE FROM facts WHERE fact = 'state'
    UNION ALL SELECT DISTINCT r.repo, 'route:' || r.repo || ':' || r.name, 'module:' || s.repo || ':' || s.path, 'routes-to', 0.7::DOUBLE FROM facts r JOIN stems s ON r.repo = s.repo AND s.kind = 'page' AND s.stem = lower(regexp_extract(r.name, '^/?([^/]*)', 1)) WHERE r.fact = 'route'
    UNION ALL SELECT t.repo, 'module:' || t.repo || ':' || t.path, 'module:' || m.repo || ':' || m.path, 'tests', 0.7::DOUBLE FROM stems t JOIN stems m ON t.repo = m.repo AND t.stem = m.stem AND t.kind = 'test' AND m.kind IN ('layout', 'module', 'page')),
  edges AS (SELECT DISTINCT repo, src, dst, type, confidence, 'edge:' || substr(@sha(src || '|' || type || '|' || dst), 1, 16) AS edge_id FROM ends WHERE src <> dst)"""


TESTED = ("layout", "module", "page")
PAIRED = EDGES[EDGES.index("    UNION ALL SELECT t.repo, 'module:' || t.repo || ':' || t.path") : EDGES.index("),\n  edges AS")]
#: The edges but those of tests: each test leads to all modules of its stem, so these grow with the square of a stem's files.
OWN = EDGES.replace(PAIRED, "").rstrip()
SALTS = 32


def facts_written(spark: SparkSession, sf_dir: str) -> None:
    """The views that nodes and edges are built over. What is read again and again is written once."""
    found = graph.checkpointed(scans.facts(scans.code_lines(repos.files(spark, sf_dir))).select("repo", "path", "fact", "kind", "name").distinct())
    found.createOrReplaceTempView("facts")
    own = graph.checkpointed(scans.scripts(found))
    own.createOrReplaceTempView("imports")
    graph.checkpointed(scans.candidates(own)).createOrReplaceTempView("tried")


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, node_id, stem, community of tests (is_test) and of the modules that they may test; a path is one row."""
    modules = NODES[NODES.index("modules AS (") : NODES.index("  bound AS (")].rstrip().removesuffix(",")
    repos.files(spark, sf_dir).select("repo", "path").createOrReplaceTempView("repo_files")
    text = f"{modules} SELECT repo, path, node_id, lower({STEM}) AS stem, {COMMUNITY.replace('source_path', 'path')} AS community, kind = 'test' AS is_test FROM modules WHERE kind IN ('test', {', '.join(map(repr, TESTED))})"
    return graph.checkpointed(spark.sql(f"WITH {spoken(text, True)}"))


def paired(stemmed: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Edges from tests to what they test, as a stream: repo, src, dst, from_community, to_community. skip: src, dst of those to leave out.

    The modules of a stem are spread over SALTS tasks, each with all tests of the stem; nothing is shuffled once it is paired.
    """
    n = max(SALTS, int(stemmed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    t = stemmed.where("is_test").select("repo", "stem", F.col("node_id").alias("src"), F.col("community").alias("from_community"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    m = stemmed.where("NOT is_test").select("repo", "stem", F.col("node_id").alias("dst"), F.col("community").alias("to_community"), F.pmod(F.hash("path"), F.lit(SALTS)).alias("salt"))
    if skip is not None:
        m = m.join(skip.groupBy("dst").agg(F.collect_set("src").alias("skipped")), "dst", "left")
    keys = ["repo", "stem", "salt"]
    both = m.repartition(n, *keys).join(t.repartition(n, *keys).hint("shuffle_hash"), keys)
    if skip is not None:
        both = both.where("skipped IS NULL OR NOT array_contains(skipped, src)")
    return both.select("repo", "src", "dst", "from_community", "to_community")


def views(spark: SparkSession, sf_dir: str, *wanted: str) -> None:
    """Makes the views that are wanted. nodes, own (the edges but those of tests), stems, and test_edges, which isn't written."""
    if {"nodes", "own"} & set(wanted):
        facts_written(spark, sf_dir)
        for b in (PATHS, FILES, DEPS):
            b.frame(spark, sf_dir).createOrReplaceTempView(b.name)
        for name, text, cte in (("nodes", NODES, "nodes"), ("own", OWN, "edges")):
            if name in wanted:
                graph.checkpointed(spark.sql(f"WITH {spoken(text, True)} SELECT * FROM {cte}")).createOrReplaceTempView(name)
    if {"stems", "test_edges"} & set(wanted):
        own = stems(spark, sf_dir)
        own.createOrReplaceTempView("stems")
        if "test_edges" in wanted:
            paired(own).createOrReplaceTempView("test_edges")
    FILES.frame(spark, sf_dir).createOrReplaceTempView("repo_files")


def over(spark: str, *wanted: str, bases: tuple[Base, ...] = ()):
    """How Spark answers a query over the program graph: a text over the views that are wanted."""

    def run(session: SparkSession, sf_dir: str) -> DataFrame:
        views(session, sf_dir, *wanted)
        for b in bases:
            b.frame(session, sf_dir).createOrReplaceTempView(b.name)
        own = spoken(spark, True)
        return session.sql(("WITH " if is_cte(own) else "") + own)

    return run


def nodes_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "nodes")
    return spark.table("nodes")


def edges_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "own", "test_edges")
    return spark.sql(ALL_EDGES)


COMMUNITY = "'community:' || repo || ':' || coalesce(nullif(regexp_extract(source_path, '^([^/]+)/', 1), ''), '.')"
TEST_ID = "'edge:' || substr(sha2(src || '|tests|' || dst, 256), 1, 16)"
ALL_EDGES = f"SELECT repo, src, dst, type, confidence, edge_id FROM own UNION ALL SELECT repo, src, dst, 'tests', 0.7D, {TEST_ID} FROM test_edges"
#: Sizes of the stems with both tests and modules, and rows of own that are an edge of a test too. Of these sizes the number of tests' edges follows.
SIZES = "sizes AS (SELECT repo, stem, count_if(is_test) AS tests, count_if(NOT is_test) AS tested FROM stems GROUP BY repo, stem)"
TOTALS = f"{SIZES}, totals AS (SELECT repo, sum(tests * tested) AS n FROM sizes GROUP BY repo HAVING sum(tests * tested) > 0)"
BASE_SQL = ", ".join(tables(NEEDS))
NODES_BASE = Base("nodes", nodes_frame, f"{BASE_SQL}, {spoken(NODES, False)}")
EDGES_BASE = Base("edges", edges_frame, f"{BASE_SQL}, {spoken(EDGES, False)}")
STARTS.insert(0, NODES_BASE.sql)
BOTH = [NODES_BASE, EDGES_BASE]
#: Pairs of own rows that are an edge of a test too.
MARKED = "marked AS (SELECT DISTINCT l.src, l.dst FROM lifted l JOIN stems t ON l.src = t.node_id AND t.is_test JOIN stems m ON l.dst = m.node_id AND NOT m.is_test AND m.repo = t.repo AND m.stem = t.stem)"


def own_text(text: str) -> str:
    """A text over edges, over those but of tests."""
    return text.replace("FROM edges", "FROM own")


define("program_nodes", [NODES_BASE], "SELECT repo, node_id, kind, label, source_path, confidence FROM nodes", "Nodes of the program graph: modules, pages, tests, symbols, packages, routes, endpoints, states, and what isn't resolved.")
define("program_edges", [EDGES_BASE], "SELECT repo, edge_id, src, dst, type, confidence FROM edges", "Typed edges of the program graph.")
define("program_graph_issues", BOTH, """SELECT edge_id AS subject, 'EDGE_FROM_UNKNOWN' AS issue FROM edges e ANTI JOIN nodes n ON e.src = n.node_id UNION ALL SELECT edge_id, 'EDGE_TO_UNKNOWN' FROM edges e ANTI JOIN nodes n ON e.dst = n.node_id
  UNION ALL SELECT node_id, 'NODE_ID_DUPLICATE' FROM nodes GROUP BY node_id HAVING count(*) > 1 UNION ALL SELECT edge_id, 'EDGE_ID_DUPLICATE' FROM edges GROUP BY edge_id HAVING count(*) > 1""", "Broken references and repeated ids of the program graph.", over(f"""SELECT edge_id AS subject, 'EDGE_FROM_UNKNOWN' AS issue FROM own e ANTI JOIN nodes n ON e.src = n.node_id UNION ALL SELECT edge_id, 'EDGE_TO_UNKNOWN' FROM own e ANTI JOIN nodes n ON e.dst = n.node_id
  UNION ALL SELECT node_id, 'NODE_ID_DUPLICATE' FROM nodes GROUP BY node_id HAVING count(*) > 1 UNION ALL SELECT 'edge:' || lower(hex(k)), 'EDGE_ID_DUPLICATE' FROM (SELECT unhex(substr(edge_id, 6)) AS k FROM own UNION ALL SELECT unhex(substr({TEST_ID}, 6)) FROM test_edges) i GROUP BY k HAVING count(*) > 1""", "nodes", "own", "test_edges"))
METRICS = """n AS (SELECT repo, count(*) AS nodes, count_if(kind IN ('layout', 'module', 'page', 'test')) AS modules, count_if(kind = 'symbol') AS symbols, count_if(kind = 'unresolved-module') AS unresolved FROM nodes GROUP BY repo), e AS (SELECT repo, count(*) AS edges, count_if(type = 'imports') AS imports FROM edges GROUP BY repo)
  SELECT n.repo, nodes::BIGINT AS nodes, modules::BIGINT AS modules, symbols::BIGINT AS symbols, unresolved::BIGINT AS unresolved, coalesce(edges, 0)::BIGINT AS edges, coalesce(imports, 0)::BIGINT AS imports, CASE WHEN coalesce(imports, 0) > 0 THEN round(1 - unresolved::DOUBLE / imports, 6) ELSE 1.0::DOUBLE END AS resolution FROM n LEFT JOIN e ON n.repo = e.repo"""
define("program_metrics", BOTH, METRICS, "Counts of each repository's graph and the share of its imports that resolve.", over(f"{TOTALS}, " + METRICS.replace("SELECT repo, count(*) AS edges, count_if(type = 'imports') AS imports FROM edges GROUP BY repo", "SELECT repo, sum(edges) AS edges, sum(imports) AS imports FROM (SELECT repo, count(*) AS edges, count_if(type = 'imports') AS imports FROM own GROUP BY repo UNION ALL SELECT repo, n, 0 FROM totals) u GROUP BY repo"), "nodes", "own", "stems"))
define("program_diagnostics", [NODES_BASE], "SELECT 'diagnostic:' || substr(@sha(node_id), 1, 16) AS diagnostic_id, repo, 'unresolved-import' AS kind, 'warning' AS severity, label AS message FROM nodes WHERE kind = 'unresolved-module'", "A diagnostic for each import that doesn't resolve.")
define("program_kinds", BOTH, "SELECT 'node' AS part, kind, count(*)::BIGINT AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', type, count(*)::BIGINT FROM edges GROUP BY type", "Nodes by kind and edges by type.", over(f"{TOTALS} SELECT 'node' AS part, kind, count(*)::BIGINT AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', type, count(*)::BIGINT FROM own GROUP BY type UNION ALL SELECT 'edge', 'tests', sum(n)::BIGINT FROM totals HAVING count(*) > 0", "nodes", "own", "stems"))
ELIGIBLE = "selected AS (SELECT repo, node_id, source_path FROM nodes WHERE kind NOT IN ('external-package', 'unresolved-module') AND source_path IS NOT NULL), eligible AS (SELECT e.repo, e.edge_id, e.src, e.dst, e.type FROM edges e SEMI JOIN selected a ON e.src = a.node_id SEMI JOIN selected b ON e.dst = b.node_id)"
define("community_edges", BOTH, f"{ELIGIBLE} SELECT edge_id, src, dst, type FROM eligible", "Edges whose both ends may be in a community.", over(f"{own_text(ELIGIBLE)} SELECT edge_id, src, dst, type FROM eligible UNION ALL SELECT {TEST_ID}, src, dst, 'tests' FROM test_edges", "nodes", "own", "test_edges"))


def community_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that only a test joins pass as a stream; the others are counted, and a test's edge added where there is one."""
    views(spark, sf_dir, "nodes", "own", "stems")
    text = f"""{own_text(ELIGIBLE)}, g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight FROM eligible GROUP BY least(src, dst), greatest(src, dst))
      SELECT a, b, weight, CASE WHEN x.is_test THEN a ELSE b END AS src, CASE WHEN x.is_test THEN b ELSE a END AS dst, y.node_id IS NOT NULL AS tested FROM g LEFT JOIN stems x ON a = x.node_id LEFT JOIN stems y ON b = y.node_id AND x.repo = y.repo AND x.stem = y.stem AND x.is_test <> y.is_test"""
    counted = graph.checkpointed(spark.sql(f"WITH {spoken(text, True)}"))
    alone = paired(spark.table("stems"), counted.where("tested").select("src", "dst"))
    return counted.selectExpr("a", "b", "weight + CAST(tested AS INT) AS weight").union(alone.selectExpr("least(src, dst)", "greatest(src, dst)", "1L"))


define("community_graph", BOTH, f"{ELIGIBLE} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*)::BIGINT AS weight FROM eligible GROUP BY least(src, dst), greatest(src, dst)", "The undirected graph that communities are found in: each edge adds 1 to its pair.", community_graph)
GROUPED = f"{ELIGIBLE}, homes AS (SELECT node_id, repo, source_path, 'community:' || repo || ':' || coalesce(nullif(regexp_extract(source_path, '^([^/]+)/', 1), ''), '.') AS community FROM selected)"
define("community_edge_split", BOTH, f"""{GROUPED} SELECT e.edge_id, e.type, a.community AS from_community, b.community AS to_community, a.community <> b.community AS crosses FROM eligible e JOIN homes a ON e.src = a.node_id JOIN homes b ON e.dst = b.node_id""", "Edges inside communities (top directories) and across them.", over(f"""{own_text(GROUPED)} SELECT e.edge_id, e.type, a.community AS from_community, b.community AS to_community, a.community <> b.community AS crosses FROM eligible e JOIN homes a ON e.src = a.node_id JOIN homes b ON e.dst = b.node_id
  UNION ALL SELECT {TEST_ID}, 'tests', from_community, to_community, from_community <> to_community FROM test_edges""", "nodes", "own", "test_edges"))
define("community_entries", BOTH, f"""{GROUPED}, placed AS (SELECT e.src, e.dst, a.community AS ca, b.community AS cb FROM eligible e JOIN homes a ON e.src = a.node_id JOIN homes b ON e.dst = b.node_id), boundary AS (SELECT ca AS community, src AS node_id FROM placed WHERE ca <> cb UNION SELECT cb, dst FROM placed WHERE ca <> cb),
  incoming AS (SELECT dst AS node_id FROM placed WHERE ca = cb), entries AS (SELECT community, node_id FROM boundary UNION SELECT h.community, h.node_id FROM homes h ANTI JOIN incoming i ON h.node_id = i.node_id WHERE @starts(h.node_id, 'module:')) SELECT community, node_id FROM entries""", "Entry entities of each community: what lies at its boundary, and modules that nothing inside leads to.", over(f"""{own_text(GROUPED)}, placed AS (SELECT e.src, e.dst, a.community AS ca, b.community AS cb FROM eligible e JOIN homes a ON e.src = a.node_id JOIN homes b ON e.dst = b.node_id), sides AS (SELECT repo, stem, is_test, min(community) AS lo, max(community) AS hi FROM stems GROUP BY repo, stem, is_test),
  boundary AS (SELECT ca AS community, src AS node_id FROM placed WHERE ca <> cb UNION SELECT cb, dst FROM placed WHERE ca <> cb UNION SELECT s.community, s.node_id FROM stems s JOIN sides o ON s.repo = o.repo AND s.stem = o.stem AND s.is_test <> o.is_test WHERE o.lo <> s.community OR o.hi <> s.community),
  incoming AS (SELECT dst AS node_id FROM placed WHERE ca = cb UNION ALL SELECT m.node_id FROM stems m SEMI JOIN (SELECT repo, stem, community FROM stems WHERE is_test) t ON m.repo = t.repo AND m.stem = t.stem AND m.community = t.community WHERE NOT m.is_test),
  entries AS (SELECT community, node_id FROM boundary UNION SELECT h.community, h.node_id FROM homes h ANTI JOIN incoming i ON h.node_id = i.node_id WHERE @starts(h.node_id, 'module:')) SELECT community, node_id FROM entries""", "nodes", "own", "stems"))
define("community_members", BOTH, f"{GROUPED}, m AS (SELECT community, count(*) AS members, count(DISTINCT source_path) AS files FROM homes GROUP BY community), i AS (SELECT a.community, count(*) AS inside FROM eligible e JOIN homes a ON e.src = a.node_id JOIN homes b ON e.dst = b.node_id AND a.community = b.community GROUP BY a.community) SELECT m.community, members::BIGINT AS members, files::BIGINT AS files, coalesce(inside, 0)::BIGINT AS internal_edges FROM m LEFT JOIN i ON m.community = i.community", "Members, files and inner edges of each community.", over(f"{own_text(GROUPED)}, m AS (SELECT community, count(*) AS members, count(DISTINCT source_path) AS files FROM homes GROUP BY community), i AS (SELECT community, sum(inside) AS inside FROM (SELECT a.community, count(*) AS inside FROM eligible e JOIN homes a ON e.src = a.node_id JOIN homes b ON e.dst = b.node_id AND a.community = b.community GROUP BY a.community UNION ALL SELECT community, count_if(is_test) * count_if(NOT is_test) FROM stems GROUP BY repo, stem, community) u GROUP BY community HAVING sum(inside) > 0) SELECT m.community, members::BIGINT AS members, files::BIGINT AS files, coalesce(inside, 0)::BIGINT AS internal_edges FROM m LEFT JOIN i ON m.community = i.community", "nodes", "own", "stems"))
define("unassigned_nodes", BOTH, f"{ELIGIBLE} SELECT n.node_id, n.kind FROM nodes n ANTI JOIN selected s ON n.node_id = s.node_id", "Nodes that no community takes.", over(f"{ELIGIBLE.split(', eligible AS')[0]} SELECT n.node_id, n.kind FROM nodes n ANTI JOIN selected s ON n.node_id = s.node_id", "nodes"))
OWNED = "owner AS (SELECT e.dst AS node_id, max(e.src) AS owner FROM edges e WHERE e.type = 'declares' GROUP BY e.dst), owners AS (SELECT n.node_id, coalesce(o.owner, CASE WHEN n.source_path IS NOT NULL THEN 'module:' || n.repo || ':' || n.source_path ELSE n.node_id END) AS owner FROM nodes n LEFT JOIN owner o ON n.node_id = o.node_id)"
define("entity_owners", BOTH, f"{OWNED} SELECT node_id, owner FROM owners", "The module that owns each entity: that which declares it, else the one of its path.", over(f"{own_text(OWNED)} SELECT node_id, owner FROM owners", "nodes", "own"))
define("program_file_relations", BOTH, f"""{OWNED} SELECT a.owner AS from_module, b.owner AS to_module, e.type, count(*)::BIGINT AS n FROM edges e JOIN owners a ON e.src = a.node_id JOIN owners b ON e.dst = b.node_id WHERE a.owner <> b.owner GROUP BY a.owner, b.owner, e.type""", "Edges at the grain of modules, by type.", over(f"""{own_text(OWNED)} SELECT a.owner AS from_module, b.owner AS to_module, e.type, count(*)::BIGINT AS n FROM own e JOIN owners a ON e.src = a.node_id JOIN owners b ON e.dst = b.node_id WHERE a.owner <> b.owner GROUP BY a.owner, b.owner, e.type UNION ALL SELECT src, dst, 'tests', 1L FROM test_edges""", "nodes", "own", "test_edges"))
DEPEND = "type IN ('imports', 'renders-component', 'composes', 'routes-to', 'requests')"
define("product_entities", [NODES_BASE], "SELECT node_id AS entity_id, CASE kind WHEN 'page' THEN 'surface' WHEN 'route' THEN 'surface' WHEN 'endpoint' THEN 'contract' WHEN 'state' THEN 'state' ELSE 'code' END AS kind, label, least(confidence, 1.0::DOUBLE) AS confidence FROM nodes", "Entities of the application map.")
define("product_relations", [EDGES_BASE], f"SELECT 'relation:' || substr(edge_id, 6) AS relation_id, src, dst, type, confidence FROM edges WHERE {DEPEND}", "Relations of the application map.", over(f"SELECT 'relation:' || substr(edge_id, 6) AS relation_id, src, dst, type, confidence FROM own WHERE {DEPEND}", "own"))
define("changed_entities", [NODES_BASE, FILES], "changed AS (SELECT DISTINCT repo, path FROM repo_files WHERE file_id % 10 = 0) SELECT n.node_id, n.kind FROM nodes n SEMI JOIN changed c ON n.repo = c.repo AND n.source_path = c.path", "Entities in the files of a change set (every tenth file): what is invalidated.")
define("state_systems", [CODE_FACTS], "SELECT repo, name AS system, count(DISTINCT path)::BIGINT AS files, @set(path) AS paths FROM facts WHERE fact = 'state' GROUP BY repo, name", "Stores and the files that use them.")
define("flow_candidates", [CODE_FACTS], """routes AS (SELECT DISTINCT repo, path, '/' || coalesce(nullif(regexp_extract(name, '^/?([^/]+(?:/[^/]+)?)', 1), ''), '') AS family FROM facts WHERE fact = 'route' AND name NOT IN ('', '/', '*')) SELECT repo, family, count(*)::BIGINT AS routes, @set(path) AS paths FROM routes GROUP BY repo, family""", "Families of routes, candidates for core flows.")
define("route_ambiguities", [CODE_FACTS], """routes AS (SELECT DISTINCT repo, path, '/' || coalesce(nullif(regexp_extract(name, '^/?([^/]+(?:/[^/]+)?)', 1), ''), '') AS family FROM facts WHERE fact IN ('route', 'navigation') AND name NOT IN ('', '/', '*')) SELECT repo, family, count(DISTINCT path)::BIGINT AS hypotheses FROM routes GROUP BY repo, family HAVING count(DISTINCT path) >= 2""", "Families that two files or more claim: ambiguous.")


def _change_sql() -> str:
    return f"""WITH RECURSIVE {EDGES_BASE.sql}, back AS (SELECT DISTINCT dst AS src, src AS dst FROM edges), subjects AS (SELECT DISTINCT node_id FROM nodes WHERE kind IN ('page', 'endpoint', 'state')),
      walk AS (SELECT node_id AS subject, node_id AS node FROM subjects UNION SELECT subject, dst FROM walk JOIN back ON node = src) SELECT subject, count(*) - 1 AS affected FROM walk GROUP BY 1"""


@query(_change_sql())
def change_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities a change of each page, endpoint and state reaches, over any number of steps of the program graph.

    The tests of a stem lead to a node that stands for it, and that to what they test, which keeps the edges in proportion.
    """
    views(spark, sf_dir, "nodes", "own", "stems")
    both = spark.sql(f"""WITH {SIZES}, own_stems AS (SELECT s.node_id, s.is_test, 'tests:' || s.repo || ':' || s.stem AS hub FROM stems s JOIN sizes z ON s.repo = z.repo AND s.stem = z.stem WHERE tests > 0 AND tested > 0)
      SELECT src, dst FROM own UNION SELECT node_id, hub FROM own_stems WHERE is_test UNION SELECT hub, node_id FROM own_stems WHERE NOT is_test""")
    subjects = spark.table("nodes").where("kind IN ('page', 'endpoint', 'state')").select(F.col("node_id").alias("subject")).distinct()
    return graph.ancestors(both, subjects, F.startswith("node", F.lit("tests:"))).select("subject", F.col("n").alias("affected"))
