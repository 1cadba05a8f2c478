"""Package manifests as tables: versions and dependency names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import ANY, PKG, S, TAKEN, W
from ..functions.text import trimmed

NAMES = ("package.json", "requirements.txt", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml")
PAIRS = "array<struct<name:string,version:string>>"
JSON = "engines map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>"
PROJECT = rf"\[project\.dependencies\]({ANY})(?:\[|\z)"
CARGO = rf"\[dependencies\]({ANY})(?:\[|\z)"
REQUIRE = rf"require{W}\(({ANY})\)"


def normalized_version(v: Column) -> Column:
    """Without a leading run of range signs; a final .x is .0; nothing is 'any'."""
    return F.when(v.isNull() | (v == ""), "any").otherwise(F.regexp_replace(F.regexp_replace(v, r"^[\^~>=<]+", ""), r"(?i)\.x\z", ".0"))


def _pair(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def _entries(m: Column) -> Column:
    return F.coalesce(F.transform(F.map_entries(m), lambda e: _pair(F.lower(e["key"]), normalized_version(e["value"]))), F.array().cast(PAIRS))


def _rows(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), trimmed)


def versions(manifests: DataFrame) -> DataFrame:
    """name, version, ord, pos of every entry; of equal names the last one counts (see effective_versions).

    manifests: ord, name (the file's base name), content.  Files of other
    names and broken JSON give nothing.
    """
    c = F.col("content")
    j = F.from_json(c, JSON)
    node, npm = F.get_json_object(c, "$.engines.node"), F.get_json_object(c, "$.engines.npm")
    engines = F.filter(F.array(_pair(F.lit("node"), node), _pair(F.lit("nodejs"), node), _pair(F.lit("npm"), npm)), lambda e: F.coalesce(e["version"], F.lit("")) != "")
    package = F.concat(F.transform(engines, lambda e: _pair(e["name"], normalized_version(e["version"]))), _entries(j["dependencies"]), _entries(j["devDependencies"]))
    extract = lambda p, text, k=1: F.regexp_extract(text, p, k)
    wanted = rf"^{PKG}([<>=!]+)?(.+)?\z"
    requirements = F.transform(F.filter(_rows(c), lambda r: (r != "") & ~r.startswith("#") & r.rlike(wanted)), lambda r: _pair(F.lower(extract(wanted, r)), normalized_version(extract(wanted, r, 3))))
    listed = F.regexp_extract_all(extract(PROJECT, c), F.lit('"([^"]+)"'), F.lit(1))
    project = F.filter(F.transform(listed, lambda d: _pair(F.lower(F.get(F.split(d, "[<>=!]+"), F.lit(0))), F.coalesce(F.get(F.split(d, "[<>=!]+"), F.lit(1)), F.lit("any")))), lambda e: e["name"] != "")
    go_version = extract(rf"(?m)^go{W}(\d+\.\d+)", c)
    go_line = rf"^([^\s]+){W}v?([^\s]+)"
    go = F.concat(
        F.filter(F.array(_pair(F.lit("go"), go_version), _pair(F.lit("golang"), go_version)), lambda e: e["version"] != ""),
        F.transform(F.filter(_rows(extract(REQUIRE, c)), lambda r: r.rlike(go_line)), lambda r: _pair(extract(go_line, r), normalized_version(extract(go_line, r, 2)))),
    )
    cargo_line = rf'^{PKG}{S}={S}"?([^"\n]+)"?'
    cargo = F.transform(F.filter(F.split(extract(CARGO, c), "\n"), lambda r: r.rlike(cargo_line)), lambda r: _pair(F.lower(extract(cargo_line, r)), normalized_version(extract(cargo_line, r, 2))))
    dep = rf"<dependency>{ANY}<artifactId>{TAKEN}</artifactId>{ANY}<version>{TAKEN}</version>{ANY}</dependency>"
    every = lambda k: F.regexp_extract_all(c, F.lit(dep), F.lit(k))
    java = extract(rf"<java\.version>{TAKEN}</java\.version>", c)
    pom = F.concat(F.filter(F.array(_pair(F.lit("java"), java)), lambda e: e["version"] != ""), F.zip_with(every(1), every(2), lambda n, v: _pair(F.lower(n), normalized_version(v))))
    parsed = F.lit(None).cast(PAIRS)
    for name, pairs in zip(NAMES, (package, requirements, project, go, cargo, pom)):
        parsed = F.when(F.col("name") == name, pairs.cast(PAIRS)).otherwise(parsed)
    return manifests.select("ord", F.posexplode(parsed).alias("pos", "p")).select("ord", "pos", F.col("p.name").alias("name"), F.col("p.version").alias("version"))


def effective_versions(manifests: DataFrame) -> DataFrame:
    """name, version: of several entries the last of the last manifest."""
    return versions(manifests).groupBy("name").agg(F.max_by("version", F.struct("ord", "pos")).alias("version"))


def dependencies(manifests: DataFrame) -> DataFrame:
    """name: distinct lower-case dependency names; of package.json four sections, of pom.xml every artifact."""
    c = F.col("content")
    j = F.from_json(c, JSON)
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    extract = lambda p, text: F.regexp_extract(text, p, 1)
    package = F.concat(keys(j["dependencies"]), keys(j["devDependencies"]), keys(j["peerDependencies"]), keys(j["optionalDependencies"]))
    requirements = F.transform(F.filter(_rows(c), lambda r: ~r.startswith("#")), lambda r: extract(rf"^{PKG}", r))
    project = F.regexp_extract_all(extract(PROJECT, c), F.lit('"([^"<>=!]+)[^"]*"?'), F.lit(1))
    go = F.transform(_rows(extract(REQUIRE, c)), lambda r: extract(r"^([^\s]+)", r))
    cargo = F.transform(F.split(extract(CARGO, c), "\n"), lambda r: extract(rf"^{PKG}{S}=", r))
    pom = F.regexp_extract_all(c, F.lit(rf"<artifactId>{TAKEN}</artifactId>"), F.lit(1))
    parsed = F.lit(None).cast("array<string>")
    for name, names in zip(NAMES, (package, requirements, project, go, cargo, pom)):
        parsed = F.when(F.col("name") == name, names).otherwise(parsed)
    return manifests.select(F.explode(parsed).alias("name")).where("name <> ''").select(F.lower("name").alias("name")).distinct()
