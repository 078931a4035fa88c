"""Profiles of repositories from their manifests, dependencies and files: frameworks, kinds, roots and the support decision."""

from __future__ import annotations

from ..functions import paths as P
from ..functions.rules import any_of, quoted
from ..sources import repos
from .census import FILES, INVENTORY
from .shared import Base, define

DEPS = Base("deps", repos.dependencies, repos.DEPENDENCIES_SQL)
MANIFESTS = Base("manifests", repos.manifests, repos.MANIFESTS_SQL)
#: name, category, manifest type.
PLATFORMS = [("node", "platform", "npm"), ("maven", "build-system", "maven"), ("gradle", "build-system", "gradle"), ("go", "platform", "go"), ("rust", "platform", "cargo"), ("python", "platform", "python"), ("ruby", "platform", "bundler"), ("php", "platform", "composer"), ("dotnet", "platform", "dotnet")]
#: name, category, pattern over dependencies.
FRAMEWORKS = [
    ("vue", "frontend", r"\bvue\b|@vue/"), ("react", "frontend", r"\breact\b"), ("angular", "frontend", "angular"), ("svelte", "frontend", "svelte"), ("next", "frontend", r"\bnext\b|nextjs"), ("nuxt", "frontend", r"\bnuxt\b|nuxtjs"),
    ("vite", "frontend-tooling", "vite"), ("webpack", "frontend-tooling", "webpack"), ("node-server", "backend", any_of("@nestjs", "express", "fastify", "hapi", "koa", "nestjs")), ("spring", "backend", "spring"), ("dubbo", "backend", "dubbo"), ("hessian", "backend", "hessian"),
    ("python-web", "backend", any_of("django", "fastapi", "flask", "starlette")), ("go-web", "backend", any_of("gin-gonic", "go-chi", "gorilla/mux", "labstack/echo")), ("ruby-web", "backend", any_of("rails", "sinatra")), ("php-web", "backend", any_of("laravel", "symfony")), ("dotnet-web", "backend", "aspnet"),
]
BACKEND = [n for n, c, _ in FRAMEWORKS if c == "backend"]
RULES = ", ".join(f"({i}, {quoted(n)}, {quoted(c)}, {quoted(p)})" for i, (n, c, p) in enumerate(FRAMEWORKS, len(PLATFORMS)))
TYPES = ", ".join(f"({i}, {quoted(n)}, {quoted(c)}, {quoted(t)})" for i, (n, c, t) in enumerate(PLATFORMS))
FOUND = f"""platforms AS (SELECT * FROM (VALUES {TYPES}) t(ord, framework, category, type)), rules AS (SELECT * FROM (VALUES {RULES}) r(ord, framework, category, pattern)),
  found AS (SELECT m.repo, p.framework, p.category, p.ord, @set('evidence:manifest:' || m.path) AS evidence_refs FROM manifests m JOIN platforms p ON m.type = p.type GROUP BY m.repo, p.framework, p.category, p.ord
    UNION ALL SELECT d.repo, r.framework, r.category, r.ord, @set('evidence:manifest:' || d.path) FROM deps d JOIN rules r ON ~(lower(d.name), r.pattern) GROUP BY d.repo, r.framework, r.category, r.ord)"""
define("frameworks", [DEPS, MANIFESTS], f"{FOUND} SELECT repo, framework, category, ord, evidence_refs FROM found", "Frameworks of each repository by ordered rules over manifests and dependencies; the rules are a literal table of some rows.")
define("build_systems", [MANIFESTS], "SELECT repo, type, path, 'evidence:manifest:' || path AS evidence_ref FROM manifests", "Each manifest as a build system.")

NAMES = """runtime AS (SELECT repo, name FROM deps), names AS (
  SELECT repo, 'next' AS framework FROM runtime WHERE name = 'next' UNION SELECT repo, 'react' FROM runtime WHERE name = 'next' UNION SELECT repo, 'nuxt' FROM runtime WHERE name = 'nuxt' UNION SELECT repo, 'vue' FROM runtime WHERE name = 'nuxt'
  UNION SELECT repo, 'react' FROM runtime WHERE ~(name, '^react(-dom|-router|-router-dom)?$') UNION SELECT repo, 'vue' FROM runtime WHERE ~(name, '^vue(-router)?$|^@vue/') UNION SELECT repo, 'svelte' FROM runtime WHERE name IN ('svelte', '@sveltejs/kit') UNION SELECT repo, 'angular' FROM runtime WHERE name IN ('angular', '@angular/core')
  UNION SELECT repo, 'next' FROM repo_files WHERE ~(path, '(?i)(^|/)next\\.config\\.[cm]?[jt]s$') UNION SELECT repo, 'react' FROM repo_files WHERE ~(path, '(?i)(^|/)next\\.config\\.[cm]?[jt]s$') UNION SELECT repo, 'vue' FROM repo_files WHERE ~(path, '(?i)\\.vue$')),
  bundlers AS (SELECT repo, name AS bundler FROM runtime WHERE name IN ('next', 'nuxt', 'parcel', 'rollup') UNION SELECT repo, 'vite' FROM runtime WHERE ~(name, 'vite') UNION SELECT repo, 'webpack' FROM runtime WHERE ~(name, 'webpack') UNION SELECT repo, 'rspack' FROM runtime WHERE ~(name, 'rspack')
  UNION SELECT repo, regexp_extract(lower(path), '(vite|next|nuxt|webpack)[^/]*[.]config[.][cm]?[jt]s$', 1) FROM repo_files WHERE ~(path, '(?i)(^|/)(?:vite|next|nuxt|webpack(?:\\.[^.]+)?)\\.config\\.[cm]?[jt]s$'))""".replace("\\\\", "\\")
define("framework_names", [DEPS, FILES], f"{NAMES} SELECT repo, framework FROM names", "Frameworks that dependencies and files show.")
define("bundler_names", [DEPS, FILES], f"{NAMES} SELECT repo, bundler FROM bundlers", "Bundlers that dependencies and files show.")

ENTRY_FILES = rf"(?i)(^|/){any_of('app', 'application', 'bootstrap', 'index', 'main', 'manage', 'program', 'server', 'startup')}\.{any_of('cs', 'go', 'java', 'js', 'jsx', 'kt', 'php', 'py', 'rb', 'rs', 'scala', 'ts', 'tsx', 'vue')}$|{any_of(r'Cargo\.toml', r'go\.mod', r'package\.json', r'pom\.xml', r'pyproject\.toml', r'web\.xml')}$"
define("profile_entrypoints", [FILES], f"SELECT repo, path, regexp_extract(path, '([^/]*)$', 1) AS name, place FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path)::BIGINT AS place FROM (SELECT DISTINCT repo, path FROM repo_files WHERE ~(path, '{ENTRY_FILES}')) d) e WHERE place <= 40", "The first 40 entry points of each repository by file name, a bounded report.")
CONVENTIONAL = ["api", "app", "backend", "cmd", "frontend", "internal", "lib", "modules", "packages", "pkg", "server", "service", "services", "src", "src/main/java", "src/main/kotlin", "src/main/resources", "src/main/scala", "src/main/webapp", "src/test/java", "web"]
ROOTS = f"""prefixes AS (SELECT repo, regexp_extract(path, '^([^/]+)/', 1) AS root FROM inv UNION SELECT repo, regexp_extract(path, '^([^/]+/[^/]+)/', 1) FROM inv UNION SELECT repo, regexp_extract(path, '^([^/]+/[^/]+/[^/]+)/', 1) FROM inv), roots AS (
  SELECT repo, root FROM prefixes WHERE root IN ({', '.join(map(quoted, CONVENTIONAL))})
  UNION SELECT repo, regexp_extract(path, '^((?:.*?/)?src(?:/main/(?:java|kotlin|resources|scala|webapp)|/test/(?:java|kotlin|scala))?)/', 1) FROM inv WHERE category IN ('source', 'test', 'script', 'markup') AND NOT protected AND ~(path, '(^|/)src/')),
  ranked_roots AS (SELECT repo, root, row_number() OVER (PARTITION BY repo ORDER BY root)::BIGINT AS place FROM roots WHERE root <> '')"""
define("source_roots", [INVENTORY], f"{ROOTS} SELECT repo, root, place FROM ranked_roots WHERE place <= 80", "Conventional source roots and those at src, the first 80 of each repository.")

EXCLUDED = ["Binary Resource", "CSS", "HTML", "JSON", "Markdown", "Maven XML", "NPM JSON", "Protected Metadata", "SCSS", "Text", "XML", "YAML"]
KIND = f"""langs AS (SELECT repo, language, count(*) AS n FROM inv GROUP BY repo, language),
  spoken AS (SELECT repo, bool_or(language IN ('React', 'React TS', 'Vue')) AS front, bool_or(language IN ('C#', 'Go', 'Java', 'Kotlin', 'PHP', 'Python', 'Ruby', 'Rust', 'Scala')) AS back, bool_or(language = 'Java') AS java FROM langs GROUP BY repo),
  works AS (SELECT repo, bool_or(category LIKE 'frontend%' AND framework <> 'webpack') AS front, bool_or(category = 'backend') AS back, {', '.join(f"bool_or(framework = '{n}') AS has_{n.replace('-', '_')}" for n in ['vue', 'react', 'next', 'nuxt', *BACKEND])}, count(*) AS frameworks FROM found GROUP BY repo),
  typed AS (SELECT repo, bool_or(type <> 'npm') AS back, count(*) AS manifests, {', '.join(f"bool_or(type = '{t}') AS is_{t}" for _, _, t in PLATFORMS)} FROM manifests GROUP BY repo),
  kinds AS (SELECT s.repo, CASE WHEN coalesce(w.front, false) OR s.front THEN CASE WHEN coalesce(t.back, false) OR coalesce(w.back, false) OR s.back THEN 'fullstack' ELSE 'frontend' END WHEN coalesce(t.back, false) OR coalesce(w.back, false) OR s.back THEN 'backend' ELSE 'unknown' END AS repo_kind,
    CASE WHEN w.has_vue THEN 'vue-router' WHEN w.has_react THEN 'react-router-or-file-routes' WHEN w.has_next THEN 'next-file-routes' WHEN w.has_nuxt THEN 'nuxt-file-routes' WHEN w.has_node_server THEN 'node-http-router' WHEN w.has_python_web THEN 'python-http-router' WHEN w.has_go_web THEN 'go-http-router'
      WHEN w.has_ruby_web THEN 'ruby-http-router' WHEN w.has_php_web THEN 'php-http-router' WHEN w.has_dotnet_web THEN 'dotnet-controller' ELSE 'unknown' END AS route_style,
    t.is_maven OR t.is_gradle AS jvm, t.is_go, t.is_python, t.is_cargo, t.is_bundler, t.is_composer, t.is_dotnet, w.has_node_server, coalesce(w.frameworks, 0) AS frameworks, coalesce(t.manifests, 0) AS manifests FROM spoken s LEFT JOIN works w ON s.repo = w.repo LEFT JOIN typed t ON s.repo = t.repo)"""
PROFILE = f"""{FOUND}, {ROOTS}, {KIND},
  main AS (SELECT repo, min_by(language, struct_order) AS language FROM (SELECT repo, language, lpad(CAST(1000000000 - n AS STRING), 12, '0') || language AS struct_order FROM langs WHERE language NOT IN ({', '.join(map(quoted, EXCLUDED))})) l GROUP BY repo),
  rooted AS (SELECT repo, count(*) AS roots FROM ranked_roots GROUP BY repo)
  SELECT k.repo, k.repo_kind, k.route_style, coalesce(m.language, 'Unknown') AS primary_language,
    CASE WHEN repo_kind = 'frontend' THEN 'browser-app' WHEN repo_kind = 'fullstack' THEN 'mixed-runtime' WHEN jvm THEN 'jvm-service' WHEN is_go THEN 'go-service' WHEN is_python THEN 'python-service' WHEN is_cargo THEN 'rust-service' WHEN is_bundler THEN 'ruby-service'
      WHEN is_composer THEN 'php-service' WHEN is_dotnet THEN 'dotnet-service' WHEN has_node_server THEN 'node-service' ELSE repo_kind END AS runtime_shape,
    least(0.95::DOUBLE, round(0.45::DOUBLE + CASE WHEN manifests > 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN frameworks > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN coalesce(roots, 0) > 0 THEN 0.1::DOUBLE ELSE 0 END, 2)) AS confidence,
    (CASE WHEN repo_kind = 'unknown' THEN 1 ELSE 0 END + CASE WHEN manifests = 0 THEN 1 ELSE 0 END + CASE WHEN frameworks = 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(roots, 0) = 0 THEN 1 ELSE 0 END)::BIGINT AS warnings
  FROM kinds k LEFT JOIN main m ON k.repo = m.repo LEFT JOIN rooted r ON k.repo = r.repo"""
define("repo_profile", [INVENTORY, DEPS, MANIFESTS], PROFILE, "One row for each repository: kind, route style, language, shape, confidence and number of warnings.")
define("profile_warnings", [INVENTORY, DEPS, MANIFESTS], f"""{FOUND}, {ROOTS}, {KIND}, rooted AS (SELECT repo, count(*) AS roots FROM ranked_roots GROUP BY repo), w AS (SELECT k.*, coalesce(r.roots, 0) AS roots FROM kinds k LEFT JOIN rooted r ON k.repo = r.repo)
  SELECT repo, 'kind-unknown' AS warning FROM w WHERE repo_kind = 'unknown' UNION ALL SELECT repo, 'no-manifest' FROM w WHERE manifests = 0 UNION ALL SELECT repo, 'no-framework' FROM w WHERE frameworks = 0 UNION ALL SELECT repo, 'no-source-root' FROM w WHERE roots = 0""", "A row for each warning of a profile.")
CONFIG_FILES = ["jsconfig.json", "next.config.js", "nuxt.config.ts", "tsconfig.json", "vite.config.js", "vite.config.ts", "vue.config.js", "webpack.config.js"]
define("alias_hints", [INVENTORY, DEPS, MANIFESTS], f"""{FOUND}, src AS (SELECT DISTINCT repo FROM inv WHERE @starts(path, 'src/')), work AS (SELECT DISTINCT repo FROM found WHERE framework IN ('angular', 'next', 'node', 'nuxt', 'react', 'svelte', 'vue'))
  SELECT repo, '@' AS alias, 'src' AS target, 'src-root-heuristic' AS source FROM src UNION ALL SELECT repo, '_', 'src', 'src-root-heuristic' FROM src
  UNION ALL SELECT DISTINCT i.repo, '(config)', i.path, 'config-file-present' FROM inv i JOIN work w ON i.repo = w.repo WHERE i.path IN ({', '.join(map(quoted, CONFIG_FILES))})""", "Import aliases that a repository's layout suggests.")
EVIDENCE_FILES = rf"(?i)(^|/)(?:{any_of('Gemfile', r'Cargo\.toml', r'build\.gradle', r'composer\.json', r'go\.mod', r'jsconfig\.json', r'next\.config\.js', r'nuxt\.config\.ts', r'package\.json', r'pom\.xml', r'pyproject\.toml', r'requirements\.txt', r'settings\.gradle', r'tsconfig\.json', r'vite\.config\.[jt]s', r'vue\.config\.js', r'webpack\.config\.js')}|[^/]+\.csproj)$"
define("profile_evidence", [FILES, MANIFESTS], f"""placed AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS place FROM (SELECT DISTINCT repo, path FROM repo_files WHERE ~(path, '{EVIDENCE_FILES}')) d)
  SELECT repo, 'evidence:manifest:' || path AS evidence_ref FROM manifests UNION SELECT repo, 'evidence:file:' || path FROM placed WHERE place <= 40""", "References that a profile rests on: manifests and the first 40 configuration files.")

BOOT = rf"(?i)(^|/)(?:bootstrap|client|entry-client|index|main)\.(?:[cm]?[jt]sx?|vue)$|(^|/)pages/_app\.[cm]?[jt]sx?$|(^|/)app/layout\.[cm]?[jt]sx?$"
RANK = P.RANKS["census_bootstrap_rank"].sql("path")
define("bootstrap_candidates", [FILES], f"SELECT repo, path, {RANK} AS rank, row_number() OVER (PARTITION BY repo ORDER BY {RANK} DESC, path)::BIGINT AS place FROM (SELECT DISTINCT repo, path FROM repo_files WHERE ~(path, '{BOOT}')) b", "Files that may start a browser application, by rank.")
PACKAGE = r"(^|/)package[.]json$"
CANDIDATES = f"""boots AS (SELECT DISTINCT repo, path FROM repo_files WHERE ~(path, '{BOOT}')), package_roots AS (SELECT DISTINCT repo, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') AS root FROM (SELECT repo, path FROM repo_files WHERE ~(path, '{PACKAGE}') UNION ALL SELECT repo, path FROM manifests WHERE type = 'npm') p),
  candidates AS (SELECT repo, root FROM package_roots UNION SELECT repo, regexp_extract(path, '(?i)^((?:apps|packages)/[^/]+|(?:frontend|client|web|ui))(?:/|$)', 1) FROM repo_files WHERE ~(path, '(?i)^((?:apps|packages)/[^/]+|(?:frontend|client|web|ui))(/|$)')),
  owned AS (SELECT f.repo, f.path, coalesce(max_by(c.root, length(c.root)), '.') AS root FROM (SELECT DISTINCT repo, path FROM repo_files) f LEFT JOIN candidates c ON f.repo = c.repo AND (c.root = '.' OR @starts(f.path, c.root || '/')) GROUP BY f.repo, f.path),
  deps_of AS (SELECT repo, bool_or(name IN ({', '.join(map(quoted, ['angular', 'next', 'nuxt', 'preact', 'react', 'react-dom', 'solid-js', 'svelte', 'vue']))}) OR @starts(name, '@angular/')) AS runtime, bool_or(name IN ('parcel', 'rollup', 'rspack', 'webpack') OR ~(name, 'vite')) AS tooling FROM deps GROUP BY repo),
  files_of AS (SELECT o.repo, o.root, bool_or(~(path, '(?i)(^|/)(?:next|nuxt|vite|webpack)(?:[.][^.]+)?[.]config[.][cm]?[jt]s$')) AS config, bool_or(~(path, '{BOOT}')) AS boot, bool_or(~(path, '(?i)(^|/)index[.]html$')) AS page, bool_or(~(path, '(?i)[.](?:jsx|tsx|vue|svelte)$')) AS source FROM owned o GROUP BY o.repo, o.root),
  scored AS (SELECT c.repo, c.root, (CASE WHEN c.root = '.' AND d.runtime THEN 8 ELSE 0 END + CASE WHEN c.root = '.' AND d.tooling THEN 5 ELSE 0 END + CASE WHEN f.config THEN 5 ELSE 0 END + CASE WHEN f.boot THEN 5 ELSE 0 END + CASE WHEN f.page THEN 3 ELSE 0 END + CASE WHEN f.source THEN 2 ELSE 0 END
    + CASE WHEN ~(c.root, '(?i)(^|/)(?:frontend|client|web)(/|$)') THEN 3 ELSE 0 END + CASE WHEN ~(c.root, '(?i)(^|/)(?:ui|design-system)(/|$)') THEN 1 ELSE 0 END)::BIGINT AS score FROM candidates c LEFT JOIN deps_of d ON c.repo = d.repo LEFT JOIN files_of f ON c.repo = f.repo AND c.root = f.root),
  qualified AS (SELECT repo, root, score, bool_or(root <> '.') OVER (PARTITION BY repo) AS nested FROM scored WHERE score >= 5), frontend_roots AS (SELECT repo, root, score FROM qualified WHERE root <> '.' OR NOT nested)"""
define("package_roots", [FILES, MANIFESTS], f"SELECT DISTINCT repo, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') AS root FROM (SELECT repo, path FROM repo_files WHERE ~(path, '{PACKAGE}') UNION ALL SELECT repo, path FROM manifests WHERE type = 'npm') p", "Directories of package manifests.")
define("frontend_root_scores", [FILES, DEPS, MANIFESTS], f"{CANDIDATES} SELECT repo, root, score FROM scored", "The score of each candidate root; files and dependencies count for the longest root that holds them.")
define("frontend_roots", [FILES, DEPS, MANIFESTS], f"{CANDIDATES} SELECT repo, root, score FROM frontend_roots", "Roots that score 5 at least; nested ones win over the top.")
BACKEND_DEP = any_of("@nestjs", "aspnet", "django", "dubbo", "express", "fastapi", "fastify", "flask", "gin-gonic", "hapi", "hessian", "koa", "laravel", "rails", "spring", "symfony")
BACK = rf"""backend_roots AS (SELECT DISTINCT repo, root FROM (SELECT repo, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') AS root FROM manifests WHERE type <> 'npm' UNION ALL SELECT repo, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') FROM deps WHERE ~(name, '{BACKEND_DEP}')
    UNION ALL SELECT repo, regexp_extract(path, '(?i)^((?:apps|packages|services)/[^/]+|(?:backend|server|api))(?:/|$)', 1) FROM repo_files WHERE ~(path, '(?i)^(?:(?:apps|packages|services)/(?:backend|server|api|service)|backend|server|api)(/|$)')) b)"""
define("backend_roots", [FILES, DEPS, MANIFESTS], f"{BACK} SELECT repo, root FROM backend_roots", "Roots of servers, from manifests, dependencies and directories.")
DECISION = f"""{NAMES}, {CANDIDATES}, {BACK}, strong AS (SELECT r.repo, r.repo IN (SELECT repo FROM names) OR (r.repo IN (SELECT repo FROM bundlers) AND (r.repo IN (SELECT repo FROM boots) OR r.repo IN (SELECT repo FROM repo_files WHERE ~(path, '(?i)(^|/)index[.]html$')))) OR r.repo IN (SELECT repo FROM frontend_roots WHERE root <> '.') AS front,
    r.repo IN (SELECT repo FROM backend_roots) OR r.repo IN (SELECT repo FROM repo_files WHERE ~(path, '(?i)^(?:backend|server|services)(/|$)')) AS back, r.repo IN (SELECT repo FROM frontend_roots) AS has_root FROM (SELECT DISTINCT repo FROM repo_files) r),
  kinds AS (SELECT repo, front, has_root, CASE WHEN front AND back THEN 'fullstack' WHEN front THEN 'frontend' WHEN back THEN 'backend' ELSE 'unknown' END AS repo_kind FROM strong),
  decisions AS (SELECT repo, repo_kind, CASE WHEN repo_kind IN ('backend', 'unknown') THEN 'unsupported' WHEN repo_kind = 'fullstack' THEN CASE WHEN has_root THEN 'frontend-subtree-only' ELSE 'unsupported' END ELSE 'supported-frontend' END AS support_level,
    CASE WHEN repo_kind = 'backend' THEN 'backend-repository' WHEN repo_kind = 'unknown' THEN 'repository-kind-unknown' WHEN repo_kind = 'fullstack' AND NOT has_root THEN 'frontend-root-not-deterministically-established' END AS unsupported_reason FROM kinds)"""
define("support_decisions", [FILES, DEPS, MANIFESTS], f"{DECISION} SELECT repo, repo_kind, support_level, unsupported_reason, (SELECT count(*) FROM frontend_roots f WHERE f.repo = d.repo)::BIGINT AS frontend_roots, (SELECT count(*) FROM backend_roots b WHERE b.repo = d.repo)::BIGINT AS backend_roots FROM decisions d", "Whether each repository is supported; what isn't known fails closed.")
PRIMARY = f"""{DECISION}, chosen AS (SELECT r.repo, CASE WHEN bool_or(framework = 'next') THEN 'next' WHEN bool_or(framework = 'nuxt') THEN 'nuxt' WHEN count(CASE WHEN framework IN ('react', 'vue', 'svelte', 'angular', 'preact', 'solid') THEN 1 END) > 1 THEN 'mixed'
    ELSE coalesce(min(CASE WHEN framework IN ('react', 'vue', 'svelte', 'angular', 'preact', 'solid') THEN framework END), 'unknown') END AS framework FROM (SELECT DISTINCT repo FROM repo_files) r LEFT JOIN names n ON r.repo = n.repo GROUP BY r.repo),
  order_of AS (SELECT * FROM (VALUES (1, 'vite'), (2, 'next'), (3, 'nuxt'), (4, 'rspack'), (5, 'webpack'), (6, 'parcel'), (7, 'rollup')) o(ord, bundler)), built AS (SELECT b.repo, min_by(b.bundler, o.ord) AS bundler FROM bundlers b JOIN order_of o ON b.bundler = o.bundler GROUP BY b.repo),
  starts AS (SELECT repo, min_by(path, lpad(CAST(1000 - {RANK} AS STRING), 5, '0') || path) AS path FROM boots GROUP BY repo),
  apps AS (SELECT c.repo, c.framework, coalesce(b.bundler, CASE WHEN c.framework IN ('next', 'nuxt') THEN c.framework END, 'unknown') AS bundler, s.path AS bootstrap_path, d.support_level, c.repo IN (SELECT repo FROM deps WHERE ~(name, '(?i)(?:^|/)(?:single-spa|qiankun|module-federation)')) OR c.repo IN (SELECT repo FROM repo_files WHERE ~(path, '(?i)module-federation|federation[.]config')) AS micro,
    c.repo IN (SELECT repo FROM repo_files WHERE ~(path, '(?i)storybook')) AS stories FROM chosen c JOIN decisions d ON c.repo = d.repo LEFT JOIN built b ON c.repo = b.repo LEFT JOIN starts s ON c.repo = s.repo)"""
define("investigation_frames", [FILES, DEPS, MANIFESTS], f"""{PRIMARY} SELECT repo, framework, bundler, bootstrap_path, CASE WHEN support_level = 'unsupported' THEN 'unknown' WHEN micro THEN 'micro-frontend' WHEN support_level = 'frontend-subtree-only' THEN 'frontend-subtree' WHEN framework IN ('next', 'nuxt') THEN 'hybrid'
    WHEN bootstrap_path IS NULL AND stories THEN 'component-library' WHEN bootstrap_path IS NOT NULL THEN 'spa' ELSE 'unknown' END AS application_kind, CASE WHEN framework = 'unknown' THEN 0.0::DOUBLE WHEN repo IN (SELECT a.repo FROM deps a JOIN chosen c ON a.repo = c.repo AND a.name = c.framework) THEN 0.98::DOUBLE ELSE 0.8::DOUBLE END AS framework_confidence,
    CASE WHEN bundler = 'unknown' THEN 0.0::DOUBLE WHEN repo IN (SELECT repo FROM bundlers) THEN 0.98::DOUBLE ELSE 0.75::DOUBLE END AS bundler_confidence, CASE WHEN bootstrap_path IS NULL THEN 'unknown' WHEN framework IN ('next', 'nuxt') THEN 'framework-managed' ELSE {P.KINDS['bootstrap_kind'].sql('bootstrap_path')} END AS bootstrap_kind FROM apps""", "The frame of each repository: framework, bundler, start and kind of application, with confidences.")
define("workspace_roots", [FILES, DEPS, MANIFESTS], f"""{CANDIDATES}, near AS (SELECT DISTINCT p.repo, p.root FROM package_roots p JOIN frontend_roots f ON p.repo = f.repo AND (p.root = f.root OR f.root = '.' OR p.root = '.' OR @starts(p.root, f.root || '/') OR @starts(f.root, p.root || '/'))), every AS (SELECT repo, root FROM near UNION SELECT repo, root FROM frontend_roots)
  SELECT e.repo, e.root, CASE WHEN bool_or(f.root IS NOT NULL) THEN 'application' WHEN bool_or(o.root IS NOT NULL) THEN 'workspace' ELSE 'package' END AS kind FROM every e LEFT JOIN frontend_roots f ON e.repo = f.repo AND e.root = f.root
  LEFT JOIN every o ON e.repo = o.repo AND e.root <> o.root AND (e.root = '.' OR @starts(o.root, e.root || '/')) GROUP BY e.repo, e.root""", "Workspace roots of each repository: applications, workspaces that hold others, and packages.")
