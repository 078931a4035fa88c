"""Classification of repository paths: predicates, kinds, ranks and names, as Columns and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import Cases, Holds, any_of

SCRIPT = "[cm]?[jt]s"
AT = "(?i)(^|/)"
SOURCE = rf"(?i)\.(?:{SCRIPT}x?|vue)$"
TEST = rf"{AT}{any_of('__tests__', 'cypress', 'e2e', 'specs?', 'tests?')}(/|$)|(?i)\.(?:spec|test)\.{SCRIPT}x?$"
APP_PAGE = rf"{AT}app/(?:.*/)?page\.{SCRIPT}x?$"
BUILD_FILES = [r"package\.json", "Dockerfile", "Jenkinsfile", r"nginx\.conf", r"docker-compose\.ya?ml", r"\.gitlab-ci\.yml", r"\.github/workflows/[^/]+\.ya?ml", r"build\.(?:cjs|js|mjs|sh)", "deploy(?:ment)?[._-][^/]+", rf"webpack(?:\.[^.]+)?\.config\.{SCRIPT}"]
BUILD_FILES += [rf"{tool}\.config\.{SCRIPT}" for tool in ("next", "nuxt", "vite")]
GENERATED = [".cache", ".next", ".nuxt", ".output", ".turbo", "build", "coverage", "dist", "node_modules", "out", "vendor"]

PREDICATES = {
    "source_file": Holds(SOURCE),
    "test_file": Holds(TEST),
    "page_candidate": Holds(SOURCE, (rf"{AT}{any_of('pages', 'screens', 'views')}(/|$)", APP_PAGE), no=(TEST,)),
    "layout_candidate": Holds(SOURCE, rf"{AT}layouts?(?:/|\.|$)", no=(TEST,)),
    "quality_config": Holds(rf"{AT}{any_of('cypress', 'eslint', 'jest', 'jsconfig', 'playwright', 'prettier', 'stylelint', 'tsconfig', 'vitest')}(?:\.[^/]+)*\.(?:json|{SCRIPT})$"),
    "build_deploy": Holds((rf"{AT}{any_of(*BUILD_FILES)}$", rf"{AT}\.env(?:\.|$)")),
    "route_config": Holds((rf"{AT}[^/]*{any_of('router', 'routes?')}[^/]*\.{any_of('js', 'jsx', 'mjs', 'ts', 'tsx')}$", rf"{AT}{any_of('router', 'routes?')}/"), no=(rf"{AT}{any_of('__mocks__', 'fixtures?', 'mocks?')}(/|$)",)),
    "mock_or_fixture": Holds(rf"{AT}{any_of('__mocks__', 'fixtures?', 'mocks?')}(/|$)"),
    "route_root": Holds(rf"{AT}{any_of('router', 'routes')}(?:/|\.|$)"),
    "generated": Holds(rf"(^|/){any_of(*[g.replace('.', chr(92) + '.') for g in GENERATED])}(/|$)"),
    "application_root_file": Holds(rf"{AT}App\.(?:{SCRIPT}x?|vue)$"),
    "evidence_resource": Holds((r"(?i)\.(?:crt|jks|key|keystore|p12|pem|pfx)$", rf"{AT}{any_of('cert', 'certs', 'keys', 'keystore')}/")),
    "semantic_eligible_type": Holds(r"(?i)\.(?:[cm]?[jt]s|[jt]sx|svelte|vue)$"),
    "storybook": Holds("(?i)storybook"),
    "federation": Holds(r"(?i)module-federation|federation\.config"),
    "excluded_route": Holds((r"^/(?:40[134]|50[0-9])(?:/|$)", ":pathMatch")),
    "api_module": Holds(rf"{AT}{any_of('api', 'apis', 'clients?', 'graphql', 'requests?', 'services?')}(/|\.|$)"),
}
KINDS = {
    "api_client_kind": Cases([("(?i)graphql", "graphql-client"), ("(?i)client|http|request", "request-client-wrapper")], "api-module"),
    "auth_kind": Cases([("(?i)guard|protected.?route", "route-guard"), ("(?i)acl|permission|rbac", "ui-gate"), ("(?i)client|http|request|token", "token-client"), ("(?i)context|session|state|store", "session-state")], "unknown"),
    "build_kind": Cases([(r"(?i)\.env(?:\.|$)", "environment"), ("(?i)nginx|proxy", "proxy"), ("(?i)docker-compose|dockerfile", "container"), (r"(?i)jenkinsfile|\.github/workflows|\.gitlab-ci", "ci"), ("(?i)deploy|release", "deploy")], "build"),
    "test_kind": Cases([("(?i)cypress|e2e|playwright", "e2e"), ("(?i)eslint|prettier|stylelint", "lint"), ("(?i)jsconfig|tsconfig", "typecheck"), ("(?i)component", "component"), ("(?i)integration", "integration")], "unit"),
    "component_role": Cases([("(?i)guard|protected|require.?auth", "auth-guard"), ("(?i)layout|shell", "layout"), (rf"{AT}{any_of('pages', 'routes', 'screens', 'views?')}/", "page")]),
    "build_tool": Cases([(r"(?i)(^|/)vite\.config\.", "vite"), (r"(?i)(^|/)next\.config\.", "next"), (r"(?i)(^|/)nuxt\.config\.", "nuxt"), (r"(?i)(^|/)webpack[^/]*\.config\.", "webpack"), (r"(?i)(^|/)rollup\.config\.", "rollup")]),
    "test_tool": Cases([("(?i)playwright", "playwright"), ("(?i)cypress", "cypress"), ("(?i)vitest", "vitest"), ("(?i)jest", "jest")], "unknown"),
    "bootstrap_kind": Cases([("(?i)entry-client|hydrate|pages/_app", "hydrate")], "client-render"),
    "route_kind": Cases([("(^|/)(?:app|pages)$", "file-system")], "declarative"),
    "alias_config": Cases([(rf"{AT}jsconfig(?:\.[^/]+)?\.json$", "jsconfig"), (rf"{AT}tsconfig(?:\.[^/]+)?\.json$", "tsconfig")]),
}
#: The rooted ones look at "/" + path.
RANKS = {
    "bootstrap_rank": Cases([(r"(?i)/(?:entry-client|main)\.tsx?$", 100), (r"(?i)/(?:entry-client|main)\.jsx?$", 90), (r"(?i)/pages/_app\.", 80), (r"(?i)/app/layout\.", 75)], 50, rooted=True),
    "census_bootstrap_rank": Cases([(r"(?i)/(?:entry-client|main)\.tsx?$", 100), (r"(?i)/(?:entry-client|main)\.jsx?$", 90), (r"(?i)/pages/_app\.", 80), (r"(?i)/app/layout\.", 75), (r"(?i)/(?:bootstrap|client|index)\.", 50)], 0, rooted=True),
    "application_root_rank": Cases([(r"(?i)/app/layout\.", 100), (r"(?i)/pages/_app\.", 90), (r"/src/App\.", 80)], 50, rooted=True),
    "layout_rank": Cases([(r"(?i)/app/layout\.", 100), (r"(?i)/(?:layouts?|shells?)/index\.", 80)], 50, rooted=True),
    "page_rank": Cases([(r"(?i)/app/(?:.*/)?page\.", 100), (r"(?i)/(?:pages|views)/index\.", 80)], 50, rooted=True),
    "page_confidence": Cases([(r"(?i)/app/(?:.*/)?page\.", 0.95)], 0.75, rooted=True),
    "layout_confidence": Cases([(r"(?i)/app/layout\.", 0.95)], 0.75, rooted=True),
    "application_root_confidence": Cases([(SOURCE, 0.9)], 0.65),
    "route_root_confidence": Cases([(r"\.[^/]+$", 0.9)], 0.8),
    "bootstrap_confidence": Cases([(".", 0.95)], 0.0),
}
STOP_SEGMENTS = f"(?i)^{any_of('app', 'index', 'page', 'pages', 'screens', 'src', 'views')}$"


def page_title(path: Column) -> Column:
    """The last segment, without extension, that says more than where pages lie; the path where there is none."""
    said = F.filter(F.split(F.regexp_replace(path, r"\.[^.]+$", ""), "/"), lambda s: (s != "") & ~s.rlike(STOP_SEGMENTS))
    return F.coalesce(F.try_element_at(said, F.lit(-1)), path)


def page_title_sql(x: str) -> str:
    return f"coalesce(list_filter(string_split(regexp_replace({x}, '\\.[^.]+$', ''), '/'), lambda s: s <> '' AND NOT regexp_matches(s, '{STOP_SEGMENTS}'))[-1], {x})"


def entity_id(path: Column) -> Column:
    return F.concat(F.when(path.rlike(r"\.[^/]+$"), "file:").otherwise("directory:"), path)


def entity_id_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '\\.[^/]+$') THEN 'file:' ELSE 'directory:' END || {x}"


def module_id(path: Column) -> Column:
    return F.concat(F.lit("module:"), path)


def top_group(path: Column) -> Column:
    """The first segment; below src up to three, but never the file itself."""
    parts = F.split(path, "/")
    deep = F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(3), F.greatest(F.size(parts) - 1, F.lit(1)))), "/")
    return F.when(F.size(parts) < 2, ".").when(parts[0] == "src", deep).otherwise(parts[0])


def top_group_sql(x: str) -> str:
    return f"(SELECT CASE WHEN len(s) < 2 THEN '.' WHEN s[1] = 'src' THEN array_to_string(s[1:least(3, greatest(len(s) - 1, 1))], '/') ELSE s[1] END FROM (SELECT string_split({x}, '/') AS s))"


def route_path(route: Column) -> Column:
    """A route without query, fragment and closing slashes, with a leading one; null for the root, for * and for nothing."""
    r = F.trim(F.regexp_replace(F.trim(route), r"(?s)[?#].*$", ""))
    cut = F.regexp_replace(r, "/+$", "")
    full = F.when(F.startswith(r, F.lit("/")), F.when(cut == "", "/").otherwise(cut)).otherwise(F.concat(F.lit("/"), cut))
    return F.when(~r.isin("", "/", "*"), full)


def route_path_sql(x: str) -> str:
    r = f"trim(regexp_replace(trim({x}), '[?#].*$', '', 's'))"
    cut = f"regexp_replace({r}, '/+$', '')"
    return f"CASE WHEN {r} NOT IN ('', '/', '*') THEN CASE WHEN starts_with({r}, '/') THEN coalesce(nullif({cut}, ''), '/') ELSE '/' || {cut} END END"


def route_family(route: Column) -> Column:
    """The first two segments."""
    return F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split(route, "/"), lambda s: s != ""), 1, 2), "/"))


def route_family_sql(x: str) -> str:
    return f"'/' || array_to_string(list_filter(string_split({x}, '/'), lambda s: s <> '')[1:2], '/')"


def safe_id(value: Column) -> Column:
    """Runs of signs that ids don't take become a dash; 'unknown' where nothing is left."""
    v = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown")), "[^A-Za-z0-9_.:-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(v, F.lit("")), F.lit("unknown"))


def safe_id_sql(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(coalesce(nullif({x}, ''), 'unknown'), '[^A-Za-z0-9_.:-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"


def mapping_method(annotation: Column) -> Column:
    """The HTTP method that a mapping annotation stands for."""
    return F.when(annotation.isin("GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping"), F.upper(F.regexp_replace(annotation, "Mapping$", "")))


def mapping_path(annotation: Column, value: Column) -> Column:
    path = F.regexp_extract(value, "[\"']([^\"']+)[\"']", 1)
    return F.when(annotation.rlike("^(?:Request|Get|Post|Put|Delete|Patch)Mapping$"), path).otherwise("")
