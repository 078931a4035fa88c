"""Classification, census and scores against values worked out by hand from the rules, apart from any SQL."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import paths as P
from sparkloom.plans import census, scans

CASES = {
    "source_file": {"a.ts": True, "a.mjs": True, "a.vue": True, "a.py": False, "a.tsx.bak": False},
    "test_file": {"src/__tests__/a.ts": True, "a.spec.tsx": True, "src/contest/a.ts": False, "e2e/a.py": True, "test": True},
    "page_candidate": {"src/pages/Home.tsx": True, "src/pages/Home.test.tsx": False, "app/shop/page.tsx": True, "app/shop/page.css": False, "src/views/a.py": False},
    "layout_candidate": {"app/layout.tsx": True, "src/layouts/Main.vue": True, "src/playout.ts": False, "tests/layout.ts": False},
    "quality_config": {"jest.config.js": True, "tsconfig.build.json": True, ".eslintrc.json": False, "src/eslint.config.mjs": True},
    "build_deploy": {"Dockerfile": True, ".github/workflows/ci.yaml": True, ".env.local": True, "deploy-prod.sh": True, "webpack.prod.config.js": True, "src/deploy/a.ts": False},
    "generated": {"dist/a.js": True, "src/distance.js": False, "a/node_modules/b.js": True},
    "route_config": {"src/router/index.ts": True, "src/app.routes.ts": True, "__mocks__/router/a.ts": False, "src/a.ts": False},
    "api_client_kind": {"src/graphqlClient.ts": "graphql-client", "src/httpClient.ts": "request-client-wrapper", "src/api/users.ts": "api-module"},
    "auth_kind": {"RouteGuard.ts": "route-guard", "rbac.ts": "ui-gate", "tokenStore.ts": "token-client", "sessionStore.ts": "session-state", "login.ts": "unknown"},
    "build_kind": {".env.prod": "environment", "nginx.conf": "proxy", "Dockerfile": "container", "Jenkinsfile": "ci", "deploy.sh": "deploy", "vite.config.ts": "build"},
    "test_kind": {"cypress/a.ts": "e2e", ".eslintrc.js": "lint", "tsconfig.json": "typecheck", "Button.component.test.ts": "component", "integration/a.ts": "integration", "a.test.ts": "unit"},
    "bootstrap_rank": {"src/main.ts": 100, "entry-client.jsx": 90, "pages/_app.tsx": 80, "app/layout.tsx": 75, "src/index.ts": 50, "x.ts": 50},
    "census_bootstrap_rank": {"src/main.ts": 100, "src/index.ts": 50, "x.ts": 0},
    "application_root_rank": {"app/layout.tsx": 100, "pages/_app.js": 90, "src/App.vue": 80, "src/app.vue": 50},
    "page_confidence": {"app/a/page.tsx": 0.95, "src/pages/a.tsx": 0.75},
}


@pytest.mark.parametrize("name", CASES)
def test_rules(spark, name):
    rule = {**P.PREDICATES, **P.KINDS, **P.RANKS}[name]
    rows = spark.createDataFrame([(p,) for p in CASES[name]], "p string").select("p", rule.column(F.col("p")).alias("v")).collect()
    assert {r["p"]: r["v"] for r in rows} == CASES[name]


def test_names(spark):
    paths = {"src/pages/user/index.tsx": ("user", "src/pages/user", "src-pages-user-index.tsx", "file:src/pages/user/index.tsx"), "src/pages": ("src/pages", "src", "src-pages", "directory:src/pages"), "a b/c.ts": ("c", "a b", "a-b-c.ts", "file:a b/c.ts"), "src/a/b/c/d.ts": ("d", "src/a/b", "src-a-b-c-d.ts", "file:src/a/b/c/d.ts"), "x.md": ("x", ".", "x.md", "file:x.md")}
    p = F.col("p")
    rows = spark.createDataFrame([(k,) for k in paths], "p string").select("p", P.page_title(p).alias("t"), P.top_group(p).alias("g"), P.safe_id(p).alias("s"), P.entity_id(p).alias("e")).collect()
    assert {r["p"]: (r["t"], r["g"], r["s"], r["e"]) for r in rows} == paths
    routes = {"/a/b/?x": "/a/b", "a/": "/a", "/": None, "*": None, "": None, "//": "/", "/a/b/c#d": "/a/b/c"}
    rows = spark.createDataFrame([(k,) for k in routes], "r string").select("r", P.route_path(F.col("r")).alias("n")).collect()
    assert {r["r"]: r["n"] for r in rows} == routes
    family = spark.createDataFrame([("/a/b/c",), ("/a",)], "r string").select(P.route_family(F.col("r"))).collect()
    assert [r[0] for r in family] == ["/a/b", "/a"]


def test_inventory(spark):
    files = {
        "src/a.ts": ("a\nb", "TypeScript", "source", 2, True), "README.md": ("", "Markdown", "docs", 0, True), ".env": ("x", "Protected Metadata", "protected", 1, False), "certs/ca.pem": ("x", "Protected Metadata", "protected", 1, False), "my-token.txt": ("x", "Text", "protected", 1, False),
        "package.json": ("{}", "NPM JSON", "manifest", 1, True), "config/app.yaml": ("a: 1", "YAML", "config", 1, True), "src/a.test.ts": ("t", "TypeScript", "test", 1, True), "db/a.ts": ("t", "TypeScript", "data", 1, True), "run.sh": ("t", "Shell", "script", 1, True), "a.css": ("t", "CSS", "markup", 1, True), "blob": ("\x01\x02\x03", "Binary Resource", "resource", 1, False), "Main.java": ("a\r\nb\r\nc", "Java", "source", 3, True),
    }
    df = spark.createDataFrame([(i, "r", p, v[0]) for i, (p, v) in enumerate(files.items())], "file_id bigint, repo string, path string, text string")
    got = {r["path"]: (r["language"], r["category"], r["lines"], r["content_analyzable"]) for r in census.inventory(df).collect()}
    assert got == {p: v[1:] for p, v in files.items()}


def test_signals_and_hits(spark):
    text = "// const x = load()\nconst x = 1\nawait load()\n<UserCard />\nplain words\nconsole.log('a') // TODO"
    df = spark.createDataFrame([(1, "r", "a.ts", text)], "file_id bigint, repo string, path string, text string")
    assert [(r["line"], r["score"]) for r in sorted(scans.signals(df).collect(), key=lambda r: r["line"])] == [(2, 5), (3, 8), (4, 4)]
    from sparkloom.functions import text as X

    assert {(r["rule"], r["line"]) for r in scans.hits(df, X.LINE_RULES).collect()} == {("console-log", 6), ("todo-marker", 6)}


def test_code_facts(spark):
    text = "import A from './A'\nexport const f = async (x) => 1\nconst y = import('../b')\n<Route path=\"/cart\" element={C} />\nfetch('/api')"
    df = spark.createDataFrame([(1, "r", "src/x/a.tsx", text), (2, "r", "src/x/A.tsx", ""), (3, "r", "src/b/index.ts", "")], "file_id bigint, repo string, path string, text string")
    found = scans.facts(scans.code_lines(df))
    got = {(r["line"], r["fact"], r["name"]) for r in found.collect()}
    assert got == {(1, "import", "./A"), (2, "symbol", "f"), (2, "export", "f"), (3, "import", "../b"), (4, "route", "/cart"), (4, "component", "Route"), (5, "request", "/api")}
    tried = scans.candidates(scans.scripts(found))
    hit = tried.join(df.select("repo", F.col("path").alias("target")), ["repo", "target"]).groupBy("name").agg(F.min_by("target", "rank").alias("target"))
    assert {r["name"]: r["target"] for r in hit.collect()} == {"./A": "src/x/A.tsx", "../b": "src/b/index.ts"}
