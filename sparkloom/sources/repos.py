"""Repositories that the given tables stand for: files, manifests and dependencies of REPOS repositories, each with its SQL.

A document is a file: its repository, directory and name follow from its doc_id, its text is the file's. A part is a
dependency and a supplier a manifest of the repository that its key falls to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import quoted
from .tables import table

REPOS = 12
DIRS = [
    "src/pages", "src/views/user", "src/api", "src/store", "app/dashboard", "app", "src/components", "server", "backend/api", "frontend/src", "web", "packages/ui/src", "apps/shop/src", "services/auth", "tests/e2e",
    "src/__tests__", "config", "db/migrations", ".github/workflows", "docs", "src/router", "src/layouts", "cypress/integration", "certs", "src/main/java/shop", "cmd", "dist", "__mocks__", "client/hooks",
]
NAMES = [
    "Home.tsx", "index.ts", "main.tsx", "main.js", "App.vue", "page.tsx", "layout.tsx", "_app.jsx", "client.ts", "request.js", "graphql.ts", "RouteGuard.ts", "permission.ts", "token.js", "session.ts", "package.json", "vite.config.ts",
    "Dockerfile", "docker-compose.yml", "nginx.conf", ".gitlab-ci.yml", "build.yaml", "Jenkinsfile", "deploy.sh", ".env.local", "jest.config.js", "playwright.config.ts", "tsconfig.json", "component.spec.tsx", "api.test.ts", "README.md",
    "schema.sql", "secrets.json", "id_rsa", "Main.java", "server.go", "app.py", "requirements.txt", "Makefile", "style.scss", "UserList.svelte", "routes.js", "index.html",
]
#: Two of these lines end the text of each file, so that rules over code find something in it.
CODE = [
    "import Home from './Home'", "import { load, save as store } from '@/api/client'", "const x = require('../store/session')", "export default function App() {", "export const loadUser = async () => {", "console.log('x')", "debugger", "el.innerHTML = value", "fetch('/a?token=1')", "localStorage.getItem('t')",
    "const base = 'http://localhost:3000'", "// TODO fix this", "await load()", "app.get('/users', list)", "router.post('/orders', add)", "<UserCard v-if=\"x\" />", "@GetMapping(\"/orders\")", "password = two words", "class Order extends Base {", "def main():", "func Serve() {", "{ path: '/home', component: Home }", "this.$router.push('/done')", "type Props = {}", "import './style.css'", "from app.models import User", "if (ready) {", "<Route path=\"/cart\" element={Cart} />", "name: Alice", "createRoot(node).render(<App />)", "createApp(App).mount('#app')", "<button onClick={save}>Save</button>", "<form @submit=\"send\">", "toast.success('saved')", "<p role=\"alert\" v-if=\"failed && reason\">", "setTotal(total + 1)", "store.commit('cart/add')", "router.beforeEach(check)", "navigate('/done')", "describe('cart', () => {", "const rows = await loadRows()", "emit('saved')", "computed: {", "import axios from 'axios'", "const n = ref(count)", "import { ref } from '@vue/runtime-core/dist'",
]
PACKAGES = [
    "vue", "vue-router", "react", "react-dom", "next", "nuxt", "svelte", "@angular/core", "vite", "webpack", "express", "koa", "@nestjs/core", "spring-boot", "dubbo", "fastapi", "django", "gin-gonic", "rails", "laravel",
    "lodash", "axios", "rollup", "single-spa", "parcel", "typescript", "jest", "eslint", "pinia", "hessian", "microsoft.aspnetcore", "@vue/compiler", "esbuild-loader", "left-pad", "requests", "tokio",
]
MANIFESTS = {"npm": "package.json", "maven": "pom.xml", "gradle": "build.gradle", "go": "go.mod", "cargo": "Cargo.toml", "python": "requirements.txt", "bundler": "Gemfile", "composer": "composer.json", "dotnet": "App.csproj"}


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def pick_sql(values: list[str], index: str) -> str:
    return f"([{', '.join(quoted(v) for v in values)}])[({index}) % {len(values)} + 1]"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, repo, path, text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(f"doc_id % {REPOS}").alias("r"), F.expr(f"doc_id div {REPOS}").alias("k"))
    deep = F.when(F.col("k") < 143, "").otherwise(F.concat(F.lit("p"), F.expr("k div 143").cast("string"), F.lit("/")))
    path = F.concat(pick(DIRS, F.col("r") * 7 + F.col("k") % 11), F.lit("/"), deep, pick(NAMES, F.col("r") * 5 + F.col("k") % 13))
    return docs.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("repo"), F.col("r").cast("string")).alias("repo"), path.alias("path"), F.concat_ws("\n", "text", pick(CODE, F.col("r") * 3 + F.col("k")), pick(CODE, F.col("k") * 7 + F.col("r"))).alias("text"))


FILES_SQL = f"""repo_files AS (SELECT doc_id AS file_id, 'repo' || (doc_id % {REPOS}) AS repo, {pick_sql(DIRS, f"(doc_id % {REPOS}) * 7 + (doc_id // {REPOS}) % 11")} || '/' ||
  CASE WHEN doc_id // {REPOS} < 143 THEN '' ELSE 'p' || (doc_id // {REPOS} // 143) || '/' END || {pick_sql(NAMES, f"(doc_id % {REPOS}) * 5 + (doc_id // {REPOS}) % 13")} AS path, concat_ws(chr(10), text, {pick_sql(CODE, f"(doc_id % {REPOS}) * 3 + (doc_id // {REPOS})")}, {pick_sql(CODE, f"(doc_id // {REPOS}) * 7 + (doc_id % {REPOS})")}) AS text FROM documents)"""


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, name, version, path: distinct."""
    parts = table(spark, sf_dir, "part").select(F.expr(f"p_partkey % {REPOS}").alias("r"), F.expr(f"p_partkey div {REPOS}").alias("k"), "p_size")
    name = pick(PACKAGES, F.col("r") * 5 + F.col("k") % 3)
    own = parts.select(F.concat(F.lit("repo"), F.col("r").cast("string")).alias("repo"), name.alias("name"), F.concat(F.lit("^"), F.col("p_size").cast("string"), F.lit(".0.0")).alias("version"))
    return own.groupBy("repo", "name").agg(F.min("version").alias("version")).withColumn("path", F.lit("package.json"))


DEPENDENCIES_SQL = f"""deps AS (SELECT repo, name, min(version) AS version, 'package.json' AS path FROM (SELECT 'repo' || (p_partkey % {REPOS}) AS repo, {pick_sql(PACKAGES, f"(p_partkey % {REPOS}) * 5 + (p_partkey // {REPOS}) % 3")} AS name, '^' || p_size || '.0.0' AS version FROM part) GROUP BY ALL)"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, type, path: distinct."""
    own = table(spark, sf_dir, "supplier").select(F.expr(f"s_suppkey % {REPOS}").alias("r"), F.expr(f"s_suppkey div {REPOS}").alias("k"))
    kind = F.col("r") * 2 + F.col("k") % 2
    return own.select(F.concat(F.lit("repo"), F.col("r").cast("string")).alias("repo"), pick(list(MANIFESTS), kind).alias("type"), pick(list(MANIFESTS.values()), kind).alias("path")).distinct()


MANIFESTS_SQL = f"""manifests AS (SELECT DISTINCT 'repo' || (s_suppkey % {REPOS}) AS repo, {pick_sql(list(MANIFESTS), f"(s_suppkey % {REPOS}) * 2 + (s_suppkey // {REPOS}) % 2")} AS type, {pick_sql(list(MANIFESTS.values()), f"(s_suppkey % {REPOS}) * 2 + (s_suppkey // {REPOS}) % 2")} AS path FROM supplier)"""
