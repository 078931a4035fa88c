"""What a file is: protection, category, language, textuality and the reason to read it, as Columns and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import any_of, quoted

SECRET_FILES = [".env", ".envrc", ".netrc", ".npmrc", ".pypirc", "credentials", "credentials.json", "id_dsa", "id_ecdsa", "id_ed25519", "id_rsa", "secrets.json", "service-account.json", "serviceAccountKey.json"]
KEY_STORES = ["crt", "jks", "key", "keystore", "p12", "pem", "pfx"]
MANIFESTS = ["Cargo.toml", "Gemfile", "Makefile", "Procfile", "build.gradle", "composer.json", "go.mod", "package.json", "pom.xml", "pyproject.toml", "requirements.txt", "settings.gradle"]
CONFIGS = [".babelrc", ".browserslistrc", ".editorconfig", ".env", ".env.example", ".eslintrc", ".npmrc", ".prettierrc", "Dockerfile", "application.properties", "application.yaml", "application.yml", "log4j.properties", "log4j2.xml", "nginx.conf", "tsconfig.json", "web.xml"]
SECRET_DIR = rf"(?i)(^|/){any_of(r'\.aws', r'\.azure', r'\.gcp', r'\.gnupg', r'\.ssh', 'auth', 'certs?', 'credentials?', 'keys?', 'keystore', 'private', 'secrets?')}(/|$)"
SECRET_NAME = rf"(?i)(^|[._-]){any_of('credentials?', 'passwords?', 'private[-_]?key', 'secrets?', 'tokens?')}([._-]|$)"
SECRET_LINE = rf"(?i){any_of('api[_-]?key', 'access[_-]?token', 'auth[_-]?token', 'client[_-]?secret', 'credential', 'passwd', 'password', 'private[_-]?key', 'secret', 'token')}\s*[:=]"
LANGUAGES = {
    "JavaScript": "js mjs", "React": "jsx", "TypeScript": "ts", "React TS": "tsx", "Vue": "vue", "Java": "java", "Kotlin": "kt", "Scala": "scala", "Groovy": "groovy", "Gradle": "gradle", "JSP": "jsp", "Python": "py", "Go": "go", "Rust": "rs", "Ruby": "rb", "PHP": "php", "C": "c",
    "C++": "cc cpp", "C/C++ Header": "h", "C++ Header": "hpp", "C#": "cs", "Clojure": "clj", "HTML": "html", "CSS": "css", "SCSS": "scss", "Less": "less", "JSON": "json", "XML": "xml", "YAML": "yaml yml", "Properties": "properties", "Protocol Buffers": "proto", "GraphQL": "graphql", "SQL": "sql", "Shell": "sh", "Markdown": "md",
}
NAMED = {"Maven XML": "pom.xml", "NPM JSON": "package.json", "Composer JSON": "composer.json", "Python Project": "pyproject.toml", "Python Requirements": "requirements.txt", "Go Module": "go.mod", "Cargo TOML": "Cargo.toml", "Gradle": "build.gradle settings.gradle", "Makefile": "Makefile", "Ruby Bundler": "Gemfile", "Procfile": "Procfile"}
#: Bytes that are sniffed, and above which contents aren't analysed.
SNIFF, LARGE = 8192, 2_000_000
#: path predicate of the key files' score, and of their reason.
ENTRY_LIKE = rf"(?i){any_of('api', 'application', 'bootstrap', 'config', 'controller', 'dubbo', 'facade', 'handler', 'main', 'route', 'router', 'service', 'spring', r'web\.xml')}"
DOMAIN_LIKE = rf"(?i){any_of('api', 'application', 'controller', 'facade', 'handler', 'main', 'service')}"
CATEGORIES = [  # over path, name and ext; the order is part of the meaning
    ("protected", "reason <> ''"),
    ("manifest", f"name IN ({', '.join(map(quoted, MANIFESTS))})"),
    ("resource", rf"ext IN ({', '.join(map(quoted, KEY_STORES))}) OR ~(path, '(?i)(^|/){any_of('certs?', 'keys', 'keystore')}/')"),
    ("docs", r"~(name, '(?i)README|CHANGELOG|CONTRIBUTING|\.md$')"),
    ("config", f"name IN ({', '.join(map(quoted, CONFIGS))}) OR ~(path, '(?i)(^|/){any_of('conf', 'config', 'resources')}/') OR ext IN ('json', 'properties', 'xml', 'yaml', 'yml')"),
    ("test", rf"~(path, '(?i)\.(?:spec|test)\.|(^|/){any_of('__tests__', 'tests?')}/') OR ~(path, 'src/test/')"),
    ("data", f"ext = 'sql' OR ~(path, '(?i)(^|/){any_of('db', 'migrations?', 'sql')}/')"),
    ("script", "ext IN ('gradle', 'sh') OR ~(name, '(?i)^Makefile$')"),
    ("markup", "ext IN ('css', 'html', 'jsp', 'less', 'scss')"),
    ("resource", "NOT textual"),
]
REASONS = [
    ("sensitive filename", rf"name IN ({', '.join(map(quoted, SECRET_FILES))}) OR ~(name, '^\.env(?:\.|$)')"),
    ("protected credential/certificate extension", f"ext IN ({', '.join(map(quoted, KEY_STORES))})"),
    ("sensitive directory", f"~(path, '{SECRET_DIR}')"),
    ("sensitive-looking filename", f"~(name, '{SECRET_NAME}')"),
]
KEY_REASONS = [
    ("protected metadata-only file", "category = 'protected'"), ("manifest", "category = 'manifest'"), ("documentation", "category = 'docs'"), ("metadata-only resource", "category = 'resource'"),
    ("likely entry or domain component", f"~(path, '{DOMAIN_LIKE}')"), ("configuration", "category = 'config'"),
]


def dialect(expression: str, spark: bool) -> str:
    """SQL of one engine: ~( stands for its regular-expression predicate. Spark reads backslashes in literals as escapes."""
    if spark:
        return expression.replace("~(", "regexp_like(").replace("\\", "\\\\")
    return expression.replace("~(", "regexp_matches(")


def ladder(rules: list[tuple[str, str]], default: str, spark: bool) -> str:
    return "CASE " + " ".join(f"WHEN {dialect(e, spark)} THEN {quoted(label)}" for label, e in rules) + f" ELSE {quoted(default)} END"


def language() -> Column:
    """By name, else by extension: one literal map, so the generated code stays small."""
    named = [(label, e) for label, e in language_rules() if not e.startswith("ext IN") or label == "Protected Metadata"]
    known = F.create_map(*[F.lit(x) for label, e in LANGUAGES.items() for ext in e.split() for x in (ext, label)])
    return F.coalesce(F.expr(ladder(named, "", True).replace("ELSE ''", "ELSE NULL")), F.element_at(known, F.col("ext")), F.lit("Text"))


def language_rules() -> list[tuple[str, str]]:
    protected = [("Protected Metadata", f"name IN ({', '.join(map(quoted, SECRET_FILES))}) OR ext IN ({', '.join(map(quoted, KEY_STORES))})")]
    named = [(label, f"name IN ({', '.join(map(quoted, names.split()))})") for label, names in NAMED.items()]
    extra = [("MSBuild XML", r"~(name, '(?i)\.csproj$')"), ("Binary Resource", "NOT textual")]
    return protected + named + extra + [(label, f"ext IN ({', '.join(map(quoted, e.split()))})") for label, e in LANGUAGES.items()]


#: Extensions, without the point, that are text whatever is in the file.
TEXT_EXTENSIONS = sorted(x for e in LANGUAGES.values() for x in e.split())
CONTROL = "[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]"
NAME_SQL = "regexp_extract(path, '([^/]*)$', 1)"
#: Of the name after its last point that isn't its first sign, in lower case.
EXT_SQL = r"lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\.([^.]+)$', 1))"


def sniffed_sql(spark: bool) -> str:
    """No NUL, and under 5 % other control characters, among the first SNIFF characters."""
    head = f"substr(text, 1, {SNIFF})"
    if spark:
        return f"(NOT contains({head}, chr(0)) AND regexp_count({head}, '{CONTROL.replace(chr(92), chr(92) * 2)}') < 0.05 * greatest(length({head}), 1))"
    return f"(NOT contains({head}, chr(0)) AND len(regexp_extract_all({head}, '{CONTROL}')) < 0.05 * greatest(length({head}), 1))"


def textual_sql(spark: bool) -> str:
    known = f"ext IN ({', '.join(map(quoted, TEXT_EXTENSIONS))}) OR name IN ({', '.join(map(quoted, MANIFESTS + CONFIGS))})"
    return f"({known} OR {sniffed_sql(spark)})"


def column(expression: str) -> Column:
    return F.expr(expression)


def spark_name() -> str:
    return NAME_SQL


def spark_ext() -> str:
    return EXT_SQL.replace("\\", "\\\\")


def redact(line: Column) -> Column:
    """A line whose value after the first = (else the first colon) is left out."""
    at = F.when(F.contains(line, F.lit("=")), F.locate("=", line)).otherwise(F.locate(":", line))
    return F.when(at == 0, "[REDACTED_SECRET_LINE]").otherwise(F.concat(F.substring(line, F.lit(1), at), F.lit(" [REDACTED]")))


def redact_sql(x: str) -> str:
    at = f"(CASE WHEN contains({x}, '=') THEN strpos({x}, '=') ELSE strpos({x}, ':') END)"
    return f"CASE WHEN {at} = 0 THEN '[REDACTED_SECRET_LINE]' ELSE substr({x}, 1, {at}) || ' [REDACTED]' END"


def sanitised(text: Column) -> Column:
    """A text with its secret lines redacted."""
    return F.array_join(F.transform(F.split(text, "\r?\n"), lambda x: F.when(x.rlike(SECRET_LINE), redact(x)).otherwise(x)), "\n")


def sanitised_sql(x: str) -> str:
    return rf"array_to_string(list_transform(string_split_regex({x}, '\r?\n'), lambda x: CASE WHEN regexp_matches(x, '{SECRET_LINE}') THEN {redact_sql('x')} ELSE x END), chr(10))"
