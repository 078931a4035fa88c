"""Scans of repositories' texts: line rules, quality findings, signals, and the facts that code shows (the lexer's tier)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import census as C
from ..functions import text as X
from ..functions.rules import any_of, may_match, quoted, telling
from ..operators import graph
from ..sources import repos
from .shared import STARTS, Base, define

EXAMPLES = 80


def hits(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """repo, file_id, path, rule, line, content of what rules (name, ..., pattern) match in texts.

    A pattern is first tried on the whole text and then on its lines; only lines that match become rows. What can't match
    for want of a word is left out before that.
    """
    numbered = F.transform(F.split("text", "\r?\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line"), x.alias("content")))
    none = F.array().cast("array<struct<rule:string,line:bigint,content:string>>")

    def one(name: str, pattern: str):
        said = F.transform(F.filter(numbered, lambda s: s["content"].rlike(pattern)), lambda s: F.struct(F.lit(name).alias("rule"), s["line"].alias("line"), s["content"].alias("content")))
        return F.when(may_match(F.col("text"), pattern) & F.col("text").rlike(pattern), said).otherwise(none)

    found = F.flatten(F.array(*[one(r[0], r[-1]) for r in rules]))
    # Outer, as for an inner one Spark tests the size of what is exploded before and works everything out twice.
    return df.select("repo", "file_id", "path", F.explode_outer(found).alias("h")).where("h IS NOT NULL").select("repo", "file_id", "path", "h.rule", "h.line", "h.content")


LINES_SQL = r"lines AS (SELECT repo, file_id, path, generate_subscripts(parts, 1)::BIGINT AS line, unnest(parts) AS content FROM (SELECT *, string_split_regex(text, '\r?\n') AS parts FROM repo_files))"


def hits_sql(rules: list[tuple]) -> str:
    each = " UNION ALL ".join(f"SELECT repo, file_id, path, {quoted(r[0])} AS rule, line, content FROM lines WHERE regexp_matches(content, {quoted(r[-1])})" for r in rules)
    return f"{repos.FILES_SQL}, {LINES_SQL}, hits AS ({each})"


HITS = Base("hits", lambda s, d: hits(repos.files(s, d), X.LINE_RULES), hits_sql(X.LINE_RULES))
QUALITY = Base("hits", lambda s, d: hits(repos.files(s, d), X.QUALITY_RULES), hits_sql(X.QUALITY_RULES))
RULES = f"rules AS (SELECT * FROM (VALUES {', '.join(f'({i}, {quoted(n)}, {quoted(c)})' for i, (n, c, _) in enumerate(X.LINE_RULES))}) r(ord, rule, category))"
LIMITS = f"limits AS (SELECT * FROM (VALUES {', '.join(f'({i}, {quoted(n)}, {quoted(s)}, {m})' for i, (n, s, m, _) in enumerate(X.QUALITY_RULES))}) r(ord, rule, severity, most))"
define("line_rule_counts", [HITS], f"""{RULES}, per_file AS (SELECT rule, file_id, count(*) AS n FROM hits GROUP BY rule, file_id), counts AS (SELECT rule, sum(n) AS matches, count(*) AS files FROM per_file GROUP BY rule)
  SELECT r.rule, r.category, CASE WHEN coalesce(matches, 0) > 50 THEN 'high' WHEN coalesce(matches, 0) > 10 THEN 'medium' ELSE 'low' END AS severity, coalesce(matches, 0)::BIGINT AS matches, coalesce(files, 0)::BIGINT AS files FROM rules r LEFT JOIN counts c ON r.rule = c.rule""", "Matching lines and files of each rule, zeros included, with the severity that the count gives.")
define("repo_findings", [HITS], f"""{RULES}, counts AS (SELECT repo, rule, count(*) AS n FROM hits GROUP BY repo, rule)
  SELECT 'finding:' || c.repo || ':' || c.rule AS finding_id, c.repo, r.category, CASE WHEN n > 50 THEN 'high' WHEN n > 10 THEN 'medium' ELSE 'low' END AS severity, c.rule || ' detected' AS title, n::BIGINT AS occurrences FROM counts c JOIN rules r ON c.rule = r.rule""", "A finding for each repository and rule that occurs.")
define("line_rule_examples", [HITS], f"SELECT repo, rule, path, line, snippet FROM (SELECT repo, rule, path, line, substr(trim(content), 1, 180) AS snippet, row_number() OVER (PARTITION BY repo ORDER BY path, file_id, line, rule) AS place FROM hits) e WHERE place <= {EXAMPLES}", "The first examples of each repository, a bounded report.")
define("capped_findings", [QUALITY], f"""{LIMITS}, counts AS (SELECT repo, rule, count(*) AS n FROM hits GROUP BY repo, rule) SELECT c.repo, l.rule, l.severity, n::BIGINT AS found, least(n, most)::BIGINT AS counted, n > most AS capped FROM counts c JOIN limits l ON c.rule = l.rule""", "Quality findings where each rule stops at its own limit before it is counted.")
define("quality_findings", [QUALITY], f"""{LIMITS}, placed AS (SELECT repo, rule, path, line, file_id, row_number() OVER (PARTITION BY repo, rule ORDER BY path, file_id, line) AS place FROM hits),
  kept AS (SELECT p.repo, p.rule, l.severity, p.path, p.line, row_number() OVER (PARTITION BY p.repo ORDER BY l.ord, p.path, p.file_id, p.line) AS nth FROM placed p JOIN limits l ON p.rule = l.rule AND p.place <= l.most) SELECT repo, rule, severity, path, line, nth::BIGINT AS nth FROM kept WHERE nth <= 1000""", "The findings that count, rule by rule, the first 1000 of a repository: the limit is the report's.")


def signals(df: DataFrame) -> DataFrame:
    """file_id, path, line, score, content of the lines that a signal's pattern matches; comments and blank lines don't count."""
    score = F.lit(None).cast("int")
    numbered = F.transform(F.split("text", "\r?\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line"), F.trim(x).alias("content")))

    def weighed(s):
        c = s["content"]
        w = F
        for weight, pattern in X.SIGNALS:
            w = w.when(c.rlike(pattern), weight)
        return F.struct(s["line"].alias("line"), F.when((c == "") | c.rlike(r"^(?://|/\*|\*)"), score).otherwise(w.otherwise(score)).alias("score"), c.alias("content"))

    kept = F.filter(F.transform(numbered, weighed), lambda s: s["score"].isNotNull())
    return df.select("file_id", "path", F.explode(kept).alias("s")).select("file_id", "path", "s.line", "s.score", "s.content")


WEIGHT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(c, {quoted(p)}) THEN {w}" for w, p in X.SIGNALS) + " END"
SIGNALS = Base("signals", lambda s, d: signals(repos.files(s, d)), rf"""{repos.FILES_SQL}, {LINES_SQL}, signals AS (SELECT file_id, path, line, score, c AS content FROM (SELECT *, {WEIGHT_SQL} AS score FROM (SELECT *, trim(content) AS c FROM lines) a WHERE c <> '' AND NOT regexp_matches(c, '^(?://|/\*|\*)')) b WHERE score IS NOT NULL)""")
define("semantic_signals", [SIGNALS], "SELECT file_id, line, score, substr(content, 1, 280) AS content FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, line) AS place FROM signals) p WHERE place <= 120", "The 120 lines of each file, a report, that say most: by the greatest weight of the patterns that match.")

CODE_EXTENSIONS = ["go", "java", "js", "jsx", "mjs", "py", "rs", "svelte", "ts", "tsx", "vue"]


def code_lines(df: DataFrame) -> DataFrame:
    """repo, file_id, path, ext, line, content (trimmed) of the lines of code files."""
    own = df.withColumn("ext", F.expr(C.spark_ext())).where(F.col("ext").isin(CODE_EXTENSIONS))
    return own.select("repo", "file_id", "path", "ext", F.posexplode_outer(F.split("text", "\r?\n")).alias("pos", "raw")).select("repo", "file_id", "path", "ext", (F.col("pos") + 1).cast("long").alias("line"), F.trim("raw").alias("content")).where("content <> ''")


CODE = Base("code", lambda s, d: code_lines(repos.files(s, d)), rf"""{repos.FILES_SQL}, {LINES_SQL}, code AS (SELECT repo, file_id, path, {C.EXT_SQL} AS ext, line, trim(content) AS content FROM lines WHERE {C.EXT_SQL} IN ({', '.join(map(quoted, CODE_EXTENSIONS))}) AND trim(content) <> '')""")

JS = "ext IN ('js', 'jsx', 'mjs', 'svelte', 'ts', 'tsx', 'vue')"
NAME = "[A-Za-z_][A-Za-z0-9_]*"
Q = """["'']"""
#: table, kind, which files, pattern whose group 1 is the name.
FACTS = [
    ("import", "js-import", JS, f"^import\\s+.*?\\s+from\\s+{Q}([^\"'']+){Q}"), ("import", "js-import", JS, f"^import\\s+{Q}([^\"'']+){Q}"), ("import", "js-import", JS, f"require\\({Q}([^\"'']+){Q}\\)"), ("import", "js-dynamic-import", JS, f"\\bimport\\(\\s*{Q}([^\"'']+){Q}\\s*\\)"),
    ("import", "java-import", "ext = 'java'", "^import\\s+(?:static\\s+)?([A-Za-z0-9_.*]+)\\s*;"), ("import", "python-import", "ext = 'py'", "^(?:from|import)\\s+([A-Za-z0-9_.]+)"), ("import", "go-import", "ext = 'go'", "^(?:import\\s+)?\"([^\"]+)\"$"), ("import", "rust-use", "ext = 'rs'", "^use\\s+([^;]+);"),
    ("symbol", "class", JS, f"\\bclass\\s+({NAME})"), ("symbol", "function", JS, f"\\bfunction\\s+({NAME})"), ("symbol", "function", JS, f"\\bconst\\s+({NAME})\\s*=\\s*(?:async\\s*)?\\("), ("symbol", "type", JS, f"\\b(?:interface|type)\\s+({NAME})\\s*[={{]"),
    ("symbol", "type", "ext = 'java'", f"\\b(?:class|enum|interface|record)\\s+({NAME})"), ("symbol", "function", "ext = 'py'", f"^(?:async\\s+)?def\\s+({NAME})\\s*\\("), ("symbol", "class", "ext = 'py'", f"^class\\s+({NAME})"), ("symbol", "function", "ext = 'go'", f"^func\\s+(?:\\([^)]+\\)\\s*)?({NAME})\\s*\\("), ("symbol", "item", "ext = 'rs'", f"^(?:pub\\s+)?(?:enum|fn|struct|trait)\\s+({NAME})"),
    ("export", "default", JS, f"\\bexport\\s+default\\s+(?:async\\s+)?(?:class|function)\\s+({NAME})"), ("export", "named", JS, f"\\bexport\\s+(?:async\\s+)?(?:class|const|function|interface|let|type|var)\\s+({NAME})"),
    ("route", "js-route-config", JS, f"\\bpath\\s*:\\s*{Q}([^\"'']+){Q}"), ("route", "jsx-route", JS, f"<Route\\b[^>]*\\bpath={Q}([^\"'']+){Q}"), ("route", "http-route", JS, f"\\b(?:app|router)\\.(?:delete|get|patch|post|put)\\(\\s*{Q}([^\"'']+){Q}"), ("route", "java-annotation", "ext = 'java'", f"^@(?:Delete|Get|Patch|Post|Put|Request)Mapping\\([^\"'']*{Q}([^\"'']+){Q}"),
    ("component", "tag", JS, "<([A-Z][A-Za-z0-9]*|[a-z][a-z0-9]*-[a-z0-9-]+)\\b"), ("annotation", "annotation", "ext IN ('java', 'py', 'ts')", "^@([A-Za-z_][A-Za-z0-9_.]*)"), ("entrypoint", "java-annotation", "ext = 'java'", f"^@({any_of('Component', 'Controller', 'DubboService', 'Repository', 'RestController', 'Service', 'SpringBootApplication', 'DeleteMapping', 'GetMapping', 'PatchMapping', 'PostMapping', 'PutMapping', 'RequestMapping')})\\b"),
    ("navigation", "push", JS, f"\\$?router\\.(?:push|replace)\\({Q}([^\"'']+){Q}"), ("request", "call", JS, f"\\b(?:fetch|request|axios|http)(?:\\.(?:delete|get|patch|post|put))?\\({Q}([^\"'']+){Q}"), ("bootstrap", "react-root", JS, "\\bcreateRoot\\(([^)]*)\\)"), ("bootstrap", "vue-app", JS, f"\\bcreateApp\\(({NAME})"), ("ui-element", "element", JS, "<(button|form|input|select|textarea)\\b"), ("ui-event", "handler", JS, "\\bon(Change|Click|Input|Submit)=\\{"), ("ui-event", "listener", JS, "@(change|click|input|submit)="),
    ("feedback", "message", JS, "\\b(?:message|notification|toast)\\.(error|info|success|warning)\\("), ("feedback", "live-region", JS, f"\\b(?:aria-live|role)={Q}(alert|assertive|polite|status){Q}"), ("mutation", "setter", JS, "\\bset([A-Z][A-Za-z0-9]*)\\("), ("mutation", "commit", JS, f"\\b(?:commit|dispatch)\\({Q}([^\"'']+){Q}"),
    ("guard", "route-guard", JS, "\\b(beforeEach|beforeEnter|requireAuth)\\b"), ("outcome", "navigate", JS, f"\\bnavigate\\({Q}([^\"'']+){Q}"), ("response", "await", JS, f"\\bawait\\s+({NAME})\\("), ("response", "then", JS, "\\.(catch|finally|then)\\("), ("wiring", "test", JS, f"\\b(?:describe|it|test)\\({Q}([^\"'']+){Q}"),
    ("options-api", "block", JS, "^(computed|data|methods|props|watch)\\s*[:(]"), ("emit", "event", JS, f"\\$?\\bemit\\({Q}([^\"'']+){Q}"), ("directive", "vue", JS, "\\b(v-else-if|v-for|v-if|v-model|v-show)="), ("state", "store", JS, f"\\b(?:useState|ref|reactive|defineStore)\\({Q}?({NAME})"),
]

WORDS = telling([p for _, _, _, p in FACTS])


def facts(df: DataFrame) -> DataFrame:
    """repo, file_id, path, line, content, fact, kind, name: all patterns in one pass over the lines (see code_lines).

    Lines that have no pattern's words are dropped first, and a pattern is tried only where its words are.
    """
    may = {p: F.expr(w) & may_match(F.col("content"), p) for _, _, w, p in FACTS}
    found = F.array(*[F.when(may[p] & F.col("content").rlike(p), F.struct(F.lit(t).alias("fact"), F.lit(k).alias("kind"), F.regexp_extract("content", p, 1).alias("name"))) for t, k, w, p in FACTS])
    own = df.where(reduce(lambda a, b: a | b, [F.contains("content", F.lit(w)) for w in WORDS]))
    return own.withColumn("f", F.explode_outer(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))).where("f IS NOT NULL").select("repo", "file_id", "path", "line", "content", "f.fact", "f.kind", "f.name")


FACTS_SQL = CODE.sql + ", facts AS (" + " UNION ".join(f"SELECT repo, file_id, path, line, content, '{t}' AS fact, '{k}' AS kind, regexp_extract(content, {quoted(p)}, 1) AS name FROM code WHERE {w} AND regexp_matches(content, {quoted(p)})" for t, k, w, p in FACTS) + ")"
STARTS.insert(0, FACTS_SQL)
STARTS.append(LINES_SQL)
CODE_FACTS = Base("facts", lambda s, d: facts(code_lines(repos.files(s, d))), FACTS_SQL)
#: For queries that read the facts more than once: written once, without the lines.
WRITTEN_FACTS = Base("facts", lambda s, d: graph.checkpointed(CODE_FACTS.frame(s, d).drop("content")), FACTS_SQL)
define("code_facts", [CODE_FACTS], f"SELECT file_id, path, line, fact, kind, name, 'fallback-lexer' AS source_kind, 0.7::DOUBLE AS confidence FROM facts", "Imports, symbols, exports, routes, components, annotations, entry points, requests, states and navigation in code, by patterns; a fact of a line counts once.")
define("code_fact_counts", [CODE_FACTS], f"SELECT repo, fact, kind, count(*)::BIGINT AS facts, count(DISTINCT file_id)::BIGINT AS files FROM facts GROUP BY repo, fact, kind", "Facts of each repository by kind.")
define("route_facts", [CODE_FACTS], f"""SELECT DISTINCT repo, path, line, kind, name AS route, CASE WHEN name IN ('', '/', '*') THEN NULL WHEN @starts(name, '/') THEN name ELSE '/' || name END AS route_path, '/' || coalesce(nullif(regexp_extract(name, '^/?([^/]+(?:/[^/]+)?)', 1), ''), '') AS family, ~('/' || name, '^/+(?:40[134]|50[0-9])(/|$)') OR ~(name, ':pathMatch') AS excluded FROM facts WHERE fact = 'route'""", "Routes with their normal form, the family of their first two segments, and whether they are left out.")
define("request_facts", [CODE_FACTS], f"""SELECT DISTINCT f.repo, f.path, f.line, f.name AS url, coalesce(nullif(upper(regexp_extract(f.content, '[.](get|post|put|patch|delete)[(]', 1)), ''), 'GET') AS method FROM facts f WHERE f.fact = 'request'""", "Requests with the method that the call names, GET otherwise.")
define("import_packages", [CODE_FACTS], f"""seen AS (SELECT repo, name, CASE WHEN ~(name, '^([.]|/|@/|~/)') THEN 'internal' ELSE 'external' END AS origin, kind FROM facts WHERE fact = 'import')
  SELECT repo, origin, CASE WHEN origin = 'internal' THEN NULL WHEN @starts(name, '@') THEN regexp_extract(name, '^(@[^/]+/[^/]+)', 1) ELSE regexp_extract(name, '^([^/]+)', 1) END AS package, count(*)::BIGINT AS imports, count_if(kind = 'js-dynamic-import')::BIGINT AS dynamic FROM seen GROUP BY ALL""", "External packages that are imported, and the number of internal imports.")
SEEN = {"entry": ["bootstrap", "route"], "action": ["ui-element", "ui-event"], "handler": ["symbol", "options-api"], "state": ["state", "mutation"], "request": ["request"], "response": ["response"], "feedback": ["feedback"], "outcome": ["navigation", "outcome", "emit"], "branch-failure": ["guard"]}
define("ui_facts", [CODE_FACTS], "SELECT repo, path, line, fact, kind, name FROM facts WHERE fact IN ('bootstrap', 'directive', 'emit', 'feedback', 'guard', 'mutation', 'navigation', 'options-api', 'outcome', 'response', 'ui-element', 'ui-event', 'wiring')", "What user interfaces show: starts, elements, events, feedback, guards, mutations, responses and outcomes.")
define("journey_evidence", [CODE_FACTS], f"""dims AS (SELECT * FROM (VALUES {', '.join(f'({quoted(d)}, {quoted(f)})' for d, fs in SEEN.items() for f in fs)}) d(dimension, fact)) SELECT f.repo, d.dimension, count(*)::BIGINT AS facts, count(DISTINCT f.path)::BIGINT AS files FROM facts f JOIN dims d ON f.fact = d.fact GROUP BY f.repo, d.dimension""", "Which closure dimensions the code of each repository has evidence for.")
define("handler_bindings", [WRITTEN_FACTS], "SELECT DISTINCT e.repo, e.path, e.line AS event_line, e.name AS event, s.name AS handler FROM facts e JOIN facts s ON e.file_id = s.file_id AND s.fact = 'symbol' AND s.kind = 'function' WHERE e.fact = 'ui-event'", "Events of an interface with the functions of the same file that may handle them.")
define("request_dependants", [WRITTEN_FACTS], "SELECT DISTINCT q.repo, q.path, q.name AS url, x.fact, x.name FROM facts q JOIN facts x ON q.file_id = x.file_id AND x.fact IN ('feedback', 'mutation', 'outcome', 'response') WHERE q.fact = 'request'", "What in the same file depends on a request: responses, mutations, feedback and outcomes.")
KEYWORDS = ["and", "else", "false", "if", "in", "null", "of", "this", "true", "undefined"]


def template_names(df: DataFrame) -> DataFrame:
    """file_id, path, line, name: different identifiers in the expressions of directives, without keywords."""
    said = F.array_join(F.regexp_extract_all("content", F.lit('(?:v-[a-z-]+|@[a-z]+|:[a-z-]+)="([^"]*)"'), F.lit(1)), " ")
    names = F.array_distinct(F.filter(F.regexp_extract_all(said, F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)), lambda n: ~n.isin(KEYWORDS)))
    return df.where(F.col("content").rlike('(?:v-[a-z-]+|@[a-z]+|:[a-z-]+)="')).select("file_id", "path", "line", F.explode(names).alias("name"))


define("template_dependencies", [Base("named", lambda s, d: template_names(code_lines(repos.files(s, d))), f"""{CODE.sql}, named AS (SELECT DISTINCT file_id, path, line, unnest(list_filter(regexp_extract_all(array_to_string(regexp_extract_all(content, '(?:v-[a-z-]+|@[a-z]+|:[a-z-]+)="([^"]*)"', 1), ' '), '[A-Za-z_$][A-Za-z0-9_$]*'), lambda n: n NOT IN ({', '.join(map(quoted, KEYWORDS))}))) AS name FROM code)""")], "SELECT file_id, path, line, name FROM named", "Identifiers that templates depend on.")
ENDS = ["", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.vue"]


def candidates(df: DataFrame) -> DataFrame:
    """repo, path, name, rank, target: what relative and aliased imports may stand for, in order."""
    base = X.normal_path(F.concat(X.directory(F.col("path")), F.lit("/"), F.col("name")))
    root = F.regexp_extract("path", "^((?:.*?/)?src)/", 1)
    alias = X.normal_path(F.concat(F.when(root == "", "src").otherwise(root), F.lit("/"), F.regexp_replace("name", "^[@~]/", "")))
    target = F.when(F.startswith("name", F.lit(".")), base).when(F.startswith("name", F.lit("/")), X.normal_path(F.col("name"))).when(F.col("name").rlike("^[@~]/"), alias)
    return df.select("repo", "path", "name", target.alias("base")).where("base IS NOT NULL").select("repo", "path", "name", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in ENDS])).alias("rank", "target"))


TARGET_SQL = f"""CASE WHEN starts_with(name, '.') THEN {X.normal_path_sql(X.directory_sql('path') + " || '/' || name")} WHEN starts_with(name, '/') THEN {X.normal_path_sql('name')}
  WHEN regexp_matches(name, '^[@~]/') THEN {X.normal_path_sql("coalesce(nullif(regexp_extract(path, '^((?:.*?/)?src)/', 1), ''), 'src') || '/' || regexp_replace(name, '^[@~]/', '')")} END"""


def scripts(found: DataFrame) -> DataFrame:
    """repo, path, name: different imports of scripts among facts."""
    return found.where("fact = 'import' AND kind IN ('js-import', 'js-dynamic-import')").select("repo", "path", "name").distinct()


def imports(spark, sf_dir: str) -> DataFrame:
    return scripts(facts(code_lines(repos.files(spark, sf_dir))))


IMPORTS = Base("imports", lambda s, d: graph.checkpointed(imports(s, d)), f"{FACTS_SQL}, imports AS (SELECT DISTINCT repo, path, name FROM facts WHERE fact = 'import' AND kind IN ('js-import', 'js-dynamic-import'))")
#: Over the view of imports, which comes before it.
TRIED = Base("tried", lambda s, d: candidates(s.table("imports")), f"bases AS (SELECT *, {TARGET_SQL} AS base FROM imports), tried AS (SELECT repo, path, name, rank - 1 AS rank, base || ends[rank] AS target FROM (SELECT *, {ENDS!r} AS ends, unnest(range(1, {len(ENDS) + 1})) AS rank FROM bases WHERE base IS NOT NULL))")
PATHS = Base("paths", lambda s, d: repos.files(s, d).select("repo", "path").distinct(), "paths AS (SELECT DISTINCT repo, path FROM repo_files)")
RESOLVED = "resolved AS (SELECT t.repo, t.path, t.name, min_by(t.target, t.rank) AS target, min(t.rank)::BIGINT AS rank FROM tried t JOIN paths p ON t.repo = p.repo AND t.target = p.path GROUP BY t.repo, t.path, t.name)"
define("resolved_imports", [IMPORTS, TRIED, PATHS], f"""{RESOLVED} SELECT i.repo, i.path, i.name, r.target, r.rank, CASE WHEN r.target IS NOT NULL THEN 'file' WHEN ~(i.name, '^([.]|/|@/|~/)') THEN 'unresolved' ELSE 'external' END AS resolution FROM imports i LEFT JOIN resolved r ON i.repo = r.repo AND i.path = r.path AND i.name = r.name""", "Each import resolved to the first candidate that exists: relative, from the root, or by the aliases of the nearest src.")
define("import_resolution_rate", [IMPORTS, TRIED, PATHS], f"""{RESOLVED} SELECT i.repo, count(*)::BIGINT AS imports, count(r.target)::BIGINT AS resolved, count_if(~(i.name, '^([.]|/|@/|~/)'))::BIGINT AS internal, round(count(r.target)::DOUBLE / count(*), 6) AS rate FROM imports i LEFT JOIN resolved r ON i.repo = r.repo AND i.path = r.path AND i.name = r.name GROUP BY i.repo""", "How many imports of each repository resolve to files.")
