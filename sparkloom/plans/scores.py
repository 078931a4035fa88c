"""Scores of repositories: six weighted dimensions from scans, files, frameworks and analyses, with grade and risk."""

from __future__ import annotations

from ..sources.repos import REPOS
from ..sources.tables import table
from .census import FILES
from .profile import DEPS, FOUND, MANIFESTS
from .scans import HITS
from .shared import Base, define

WEIGHTS = {"architecture": 0.18, "engineering": 0.20, "security": 0.22, "stability": 0.16, "experience": 0.12, "business": 0.12}
LABELS = Base("analyses", lambda s, d: table(s, d, "labels").selectExpr(f"concat('repo', cast(doc_id % {REPOS} as string)) AS repo", "doc_id", "quality", "toxic"), f"analyses AS (SELECT 'repo' || (doc_id % {REPOS}) AS repo, doc_id, quality, toxic FROM labels)")
CLAMP = lambda x: f"greatest(0, least(100, floor({x} + 0.5::DOUBLE)))"
SCORES = f"""{FOUND}, issues AS (SELECT repo, count(*) AS total, count_if(rule IN ('url-token', 'dom-html-injection', 'browser-storage-auth')) AS security, count_if(rule = 'debugger') AS debuggers, count_if(rule = 'console-log') AS logs FROM hits GROUP BY repo),
  shape AS (SELECT repo, bool_or(~(path, '(?i)[.](?:test|spec)[.]|(?:__tests__|tests?)/')) AS has_tests, bool_or(~(path, '(?i)eslint')) AS has_lint, bool_or(~(path, '(?i)(^|/)(?:package-lock[.]json|pnpm-lock[.]yaml|yarn[.]lock)$')) AS has_lock, bool_or(~(path, '(^|/)package[.]json$')) AS has_scripts FROM repo_files GROUP BY repo),
  stack AS (SELECT repo, bool_or(framework IN ('react', 'vue')) AS modern FROM found GROUP BY repo), risky AS (SELECT repo, count_if(toxic = 1) * 4 AS penalty FROM analyses GROUP BY repo),
  base AS (SELECT s.repo, s.has_tests, s.has_lint, s.has_lock, s.has_scripts, coalesce(i.total, 0) AS total, coalesce(i.security, 0) AS security, coalesce(i.debuggers, 0) AS debuggers, coalesce(i.logs, 0) AS logs, coalesce(k.modern, false) AS modern, coalesce(r.penalty, 0) AS penalty
    FROM shape s LEFT JOIN issues i ON s.repo = i.repo LEFT JOIN stack k ON s.repo = k.repo LEFT JOIN risky r ON s.repo = r.repo),
  dims AS (SELECT repo, {CLAMP('82 - penalty')}::BIGINT AS architecture, {CLAMP("72 + CASE WHEN has_lock THEN 8 ELSE -8 END + CASE WHEN has_scripts THEN 6 ELSE -8 END + CASE WHEN has_scripts OR has_tests THEN 6 ELSE -10 END + CASE WHEN has_lint THEN 4 ELSE 0 END - least(total, 60) * 0.2::DOUBLE")}::BIGINT AS engineering,
    {CLAMP('88 - security * 3')}::BIGINT AS security, {CLAMP("78 + CASE WHEN has_tests THEN 8 ELSE -8 END - debuggers * 4 - logs * 0.2::DOUBLE")}::BIGINT AS stability, {CLAMP('70 + CASE WHEN modern THEN 8 ELSE 0 END')}::BIGINT AS experience, 70::BIGINT AS business FROM base),
  scored AS (SELECT *, {CLAMP('round(' + ' + '.join(f'{d} * {w}::DOUBLE' for d, w in WEIGHTS.items()) + ', 9)')}::BIGINT AS score FROM dims)"""
GRADE = "CASE WHEN score >= 85 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 65 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'E' END"
RISK = "CASE WHEN score >= 75 THEN 'low' WHEN score >= 60 THEN 'medium' WHEN score >= 45 THEN 'high' ELSE 'critical' END"
NEEDS = [FILES, HITS, DEPS, MANIFESTS, LABELS]
define("repo_score", NEEDS, f"{SCORES} SELECT repo, architecture, engineering, security, stability, experience, business, score, {GRADE} AS grade, {RISK} AS risk FROM scored", "The six dimensions of each repository, their weighted score, grade and risk.")
define("audit_board", NEEDS, f"""{SCORES}, f AS (SELECT repo, count(DISTINCT rule)::BIGINT AS findings FROM hits GROUP BY repo), a AS (SELECT repo, count(*)::BIGINT AS analyses FROM analyses GROUP BY repo) SELECT s.repo, score, {GRADE} AS grade, coalesce(findings, 0)::BIGINT AS findings, coalesce(analyses, 0)::BIGINT AS analyses FROM scored s LEFT JOIN f ON s.repo = f.repo LEFT JOIN a ON s.repo = a.repo""", "Each repository with its score, findings and analyses, the rows of the board.")
define("export_gate", NEEDS, f"""{SCORES} SELECT 'repositories-empty' AS issue, count(*)::BIGINT AS rows FROM scored HAVING count(*) = 0 UNION ALL SELECT 'analyses-missing', count(*)::BIGINT FROM scored s ANTI JOIN analyses a ON s.repo = a.repo HAVING count(*) > 0
  UNION ALL SELECT 'score-out-of-range', count(*)::BIGINT FROM scored WHERE score < 0 OR score > 100 HAVING count(*) > 0 UNION ALL SELECT 'critical-risk', count(*)::BIGINT FROM scored WHERE score < 45 HAVING count(*) > 0""", "What stands against an export: no row, if nothing does.")
define("package_relationships", [DEPS], """published AS (SELECT repo, max(name) AS package FROM deps GROUP BY repo), latest AS (SELECT package, max(repo) AS repo FROM published GROUP BY package) SELECT d.repo AS from_repo, l.repo AS to_repo, d.name AS package, d.version FROM deps d JOIN latest l ON d.name = l.package WHERE d.repo <> l.repo""", "Which repository depends on the package of which; of several that publish one name the last counts.")
define("dependency_signals", [DEPS], r"""SELECT repo, count(*)::BIGINT AS dependencies, bool_or(~(name, '^(?:vue|react|svelte|@angular/core|next|nuxt)$')) AS ui, bool_or(~(name, '^(?:jest|vitest|cypress|playwright)$')) AS testing, bool_or(~(name, '^(?:eslint|prettier|typescript)$')) AS tooling, @set(name) AS names FROM deps GROUP BY repo""", "What the dependencies of a repository are for.")
