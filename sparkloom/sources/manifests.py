"""Dependencies in package manifests, as Column expressions over (path, text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

SCOPES = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]


def pairs(text: Column, pattern: str, scope: str) -> Column:
    """An array of (name, version, scope): groups 1 and 2 of every match."""
    names, versions = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.transform(F.arrays_zip(names.alias("n"), versions.alias("v")), lambda x: F.struct(x["n"].alias("name"), F.trim(x["v"]).alias("version"), F.lit(scope).alias("scope")))


def npm(text: Column) -> Column:
    def one(scope: str) -> Column:
        m = F.from_json(F.get_json_object(text, f"$.{scope}"), "map<string,string>")
        return F.transform(F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(scope).alias("scope")))

    return F.concat(*[one(s) for s in SCOPES])


def section(text: Column, header: str) -> Column:
    """The lines of a bracketed section of a TOML file, to the next header."""
    return F.regexp_extract(text, rf"(?s)(?:^|\n)\[{header}\][^\n]*\n(.*?)(?=\n\[|\z)", 1)


TOML = r"""(?m)^\s*([A-Za-z0-9_.-]+)\s*=\s*(?:\{[^}\n]*version\s*=\s*)?"([^"\n]*)\""""
DIALECTS = {
    "package.json": npm,
    "composer.json": lambda t: F.transform(F.map_entries(F.coalesce(F.from_json(F.get_json_object(t, "$.require"), "map<string,string>"), F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit("dependencies").alias("scope"))),
    "requirements.txt": lambda t: pairs(t, r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*((?:[=<>!~]=?[^#\n;]*)?)", "dependencies"),
    "go.mod": lambda t: pairs(t, r"(?m)^\s*(?:require\s+)?([a-z0-9-]+\.[a-z]+/[^\s]+)\s+(v[^\s]+)", "dependencies"),
    "cargo.toml": lambda t: F.concat(pairs(section(t, "dependencies"), TOML, "dependencies"), pairs(section(t, "dev-dependencies"), TOML, "devDependencies")),
    "pyproject.toml": lambda t: F.concat(pairs(section(t, r"tool\.poetry\.dependencies"), TOML, "dependencies"), pairs(section(t, "project"), r"""(?m)^\s*"([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*([^"\n]*)",?\s*$""", "dependencies")),
    "pom.xml": lambda t: F.transform(F.arrays_zip(F.xpath(t, F.lit("//*[local-name()='dependency']/*[local-name()='artifactId']/text()")).alias("n"), F.xpath(t, F.lit("//*[local-name()='dependency']/*[local-name()='version']/text()")).alias("v")), lambda x: F.struct(x["n"].alias("name"), x["v"].alias("version"), F.lit("dependencies").alias("scope"))),
    "build.gradle": lambda t: pairs(t, r"""(?m)^[ \t]*[a-zA-Z]*(?:[aA]pi|[cC]ompile|[cC]ompileOnly|[iI]mplementation|[kK]apt|[pP]rocessor|[rR]untime|[rR]untimeOnly)[ (]+["']([^"':\s]+:[^"':\s]+):([^"'\s]+)["']""", "dependencies"),
    "gemfile": lambda t: pairs(t, r"""(?m)^[ \t]*gem[ (]+["']([A-Za-z0-9_.-]+)["'](?:[ \t]*,[ \t]*["']([^"'\n]+)["'])?""", "dependencies"),
    "csproj": lambda t: pairs(t, r"""<PackageReference\s+Include="([^"]+)"\s+Version="([^"]+)\"""", "dependencies"),
}


def dependencies(files: DataFrame) -> DataFrame:
    """path, type, name, version, scope of each dependency that a manifest among files (path, text) names; '' without a version."""
    name = F.lower(X.file_name(F.col("path")))
    kind = F.when(X.extension(F.col("path")) == "csproj", "csproj").otherwise(name)
    some = files.select("path", "text", kind.alias("type")).where(F.col("type").isin(list(DIALECTS)))
    found = reduce(lambda c, k: c.when(F.col("type") == k, DIALECTS[k](F.col("text"))), DIALECTS, F.when(F.lit(False), F.array().cast("array<struct<name:string,version:string,scope:string>>")))
    return some.select("path", "type", F.explode(found).alias("d")).select("path", "type", "d.name", F.coalesce("d.version", F.lit("")).alias("version"), "d.scope")
