"""Scalar functions over texts and paths, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .census import LANGUAGES, SECRET_LINE, redact, redact_sql

SECRET = SECRET_LINE
#: name, category, pattern over a line. Patterns use no look-around, so other engines can run them.
LINE_RULES = [
    ("console-log", "engineering", r"\bconsole\.log\s*\("),
    ("debugger", "engineering", r"\bdebugger\b"),
    ("dom-html-injection", "security", r"\b(?:innerHTML|outerHTML)\b|v-html\s*="),
    ("url-token", "security", r"(?i)[?&](?:access_token|sessionId|ticket|token)="),
    ("browser-storage-auth", "security", r"\b(?:document\.cookie|localStorage|sessionStorage)\b"),
    ("non-prod-url", "engineering", r"(?i)\b(?:127\.0\.0\.1|localhost|qa-|sit-|test-|uat-)"),
    ("todo-marker", "engineering", r"\b(?:FIXME|HACK|TODO)\b"),
]
#: name, severity, most findings that count, pattern.
QUALITY_RULES = [
    ("debugger", "high", 200, r"\bdebugger\b"),
    ("console-log", "medium", 300, r"\bconsole\.(?:debug|info|log)\s*\("),
    ("todo", "low", 200, r"(?i)\b(?:fixme|hack|todo)\b"),
    ("html-injection", "high", 200, r"\bv-html\b|dangerouslySetInnerHTML|innerHTML"),
    ("client-storage", "medium", 300, r"\b(?:document\.cookie|localStorage|sessionStorage)\b"),
    ("runtime-address", "medium", 200, r"(?i)localhost|127\.0\.0\.1|https?://[^'\"`\s]+"),
]
#: Weight and pattern of the lines that say most about what a file is for.
SIGNALS = [
    (9, r"\b(?:activated|computed|created|data|methods|mounted|name|props|setup|watch)\s*[:(]"), (9, r"\b(?:async\s+)?(?:function\s+)?[A-Za-z_$][A-Za-z0-9_$]*\s*\([^)]*\)\s*\{"), (9, r"\b(?:export\s+(?:class|const|default|function)|module\.exports)\b"),
    (8, r"\b(?:this\.)?\$(?:confirm|emit|message|route|router|store)\b"), (8, r"\b(?:await|\.(?:catch|finally|then)\s*\()"), (8, r"(?:@change|@click|@submit|:data-source|:loading|:value|v-for|v-if|v-show)\b"), (7, r"\b(?:case|else if|if|switch)\s*[({]"),
    (7, r"(?i)\b(?:approve|create|delete|download|fetch|load|query|reject|request|save|submit|update|upload)[A-Za-z0-9_$]*\s*\("), (6, r"[\x{3400}-\x{9fff}]{2,}"), (5, r"^\s*(?:class|const|interface|let|type|var)\s+[A-Za-z_$]"), (4, r"<[A-Z][A-Za-z0-9._-]*"),
]
EXTENSIONS = {x: language for language, e in LANGUAGES.items() for x in e.split()}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Of the last segment, in lower case, '' where it has none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def directory(path: Column) -> Column:
    """Parent of a path, '.' at the top."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def normal_path(path: Column) -> Column:
    """Canonical repository path: no scheme, query or fragment, forward slashes, no '.', empty or resolvable '..' segments, at any depth."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    p = F.regexp_replace(F.regexp_replace(p, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    step = lambda s, x: F.when(x.isin("", "."), s).when((x == "..") & (F.size(s) > 0) & (F.try_element_at(s, F.lit(-1)) != ".."), F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(F.array_append(s, x))
    out = F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(out == "", ".").otherwise(out)


def within(path: Column, root: Column) -> Column:
    return (root == ".") | (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over code points, 32 bits, as base 36 in lower case. Arithmetic is done in long, so nothing overflows."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def redacted(line: Column) -> Column:
    """A line whose rest after the sign of a secret is cut."""
    return redact(line)


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and Han signs; a capital after a small letter or digit begins a new one."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.regexp_replace(F.lower(apart), "[^a-z0-9\u4e00-\u9fff]+", " "), " "), lambda t: t != "")


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9\u4e00-\u9fff]+', ' ', 'g'), ' '), lambda t: t <> '')"


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + F.lit(0.5))


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]+)", 1)


# The same functions as DuckDB SQL, over SQL expressions.


def host_sql(x: str) -> str:
    return f"regexp_extract({x}, '^[a-zA-Z]+://([^/?#]+)', 1)"


def file_name_sql(x: str) -> str:
    return f"lower(regexp_extract({x}, '([^/]*)$', 1))"


def extension_sql(x: str) -> str:
    return f"lower(regexp_extract({x}, '\\.([A-Za-z0-9]+)$', 1))"


def directory_sql(x: str) -> str:
    return f"coalesce(nullif(regexp_extract({x}, '^(.*)/[^/]*$', 1), ''), '.')"


def normal_path_sql(x: str) -> str:
    p = f"regexp_replace(trim({x}), '\\\\', '/', 'g')"
    p = f"regexp_replace(regexp_replace({p}, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '')"
    step = "CASE WHEN v[1] IN ('', '.') THEN s WHEN v[1] = '..' AND len(s) > 0 AND s[-1] <> '..' THEN s[1:len(s) - 1] ELSE list_concat(s, v) END"
    return f"coalesce(nullif(array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({p}, '/'), lambda q: [q])), lambda s, v: {step}), '/'), ''), '.')"


def redacted_sql(x: str) -> str:
    return redact_sql(x)
