"""Corpora derived from the driver's tables, in SQL that Spark and DuckDB both run.

The tables hold almost no reference syntax, so documents, source files,
manifests, commits and probe results are composed from their columns; they
grow with the tables, and hold hits, misses and near misses.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = "/project"


def _cat(*parts: str) -> str:
    return " || ".join(parts)


def _s(x: str) -> str:
    return f"cast({x} as string)"


def _text(*lines: str) -> str:
    """Lines joined by line feeds; each is an SQL expression."""
    return " || chr(10) || ".join(f"({x})" for x in lines)


K = "p_partkey"
F3 = "chr(96) || chr(96) || chr(96)"
_TREE = [f"{F3}", "'src'", _cat("'├── mod'", _s(f"{K} % 60"), "'.ts'"), "'├── utils/'", _cat("'│   └── helper'", _s(f"{K} % 4"), "'.ts'"), "'└── ab'", _cat("'    └── long-name'", _s(f"{K} % 3"), "'.ts'"), f"{F3}"]
_CODE = [
    f"{F3} || 'ts'",
    _cat("'import { makeThing'", _s(f"{K} % 50"), "', Helper'", _s(f"{K} % 9"), "' as H } from '", "chr(39)", "'./mod'", _s(f"{K} % 50"), "chr(39)", "';'"),
    _cat("'import widget, { Part } from '", "chr(39)", "'../lib/widget'", _s(f"{K} % 3"), "chr(39)"),
    _cat("'const cfg = require('", "chr(39)", "'./mod'", _s(f"{K} % 70"), "chr(39)", "')'"),
    _cat("'const opts: Options'", _s(f"{K} % 50"), "' = {'"),
    "'  size: 1,'",
    _cat("'  '", "CASE WHEN p_partkey % 3 = 0 THEN 'colr' ELSE 'color' END", "': { inner: 2 },'"),
    "'  depth,'",
    "'};'",
    _cat("'makeThing'", _s(f"{K} % 50"), "CASE WHEN p_partkey % 4 = 0 THEN '(alpha);' WHEN p_partkey % 4 = 1 THEN '(alpha, beta);' WHEN p_partkey % 4 = 2 THEN '(1, f(2, 3), [4, 5], 6);' ELSE '(first, last);' END"),
    "'service.call(x); new Thing(y); if (z) { return 1 }'",
    "'buildAll('",
    "'  one,'",
    "'  wrap(two, three),'",
    "');'",
    _cat("'class Gadget'", _s(f"{K} % 80"), "' {}'"),
    f"{F3}",
]
_PY = [f"{F3} || 'python'", _cat("'from pkg.tool'", _s(f"{K} % 40"), "' import run_all, Worker as W'"), _cat("'def handle_'", _s(f"{K} % 30"), "'(a):'"), "'    return run_all(a, b=2)'", _cat("'class Engine'", _s(f"{K} % 30"), "':'"), f"{F3}"]
_GO = [f"{F3} || 'go'", "'import \"fmt\"'", "'import ('", "'  \"os\"'", _cat("'  \"example.com/lib'", _s(f"{K} % 5"), "'\"'"), "')'", _cat("'func Build'", _s(f"{K} % 20"), "'() {}'"), _cat("'type Store'", _s(f"{K} % 20"), "' struct {}'"), f"{F3}"]
_MD = _text(
    _cat("'# Guide to '", "p_name"),
    _cat("'Intro for '", "p_brand", "' | parts.'"),
    "''",
    _cat("'Needs Node.js '", _s(f"14 + {K} % 10"), "'.1.0, nodejs '", _s(f"16 + {K} % 6"), "', React v'", _s(f"16 + {K} % 4"), "'.2 and TypeScript 5.x with PostgreSQL 16; '", "p_type", "' 1.0.0.'"),
    _cat("'See [source](../../src/mod'", _s(f"{K} % 60"), "'.ts:'", _s(f"1 + {K} % 90"), "'), [next](./p'", _s(f"{K} + 7"), "'.md), [typo](../../src/mdo'", _s(f"{K} % 60"), "'.ts#L4-L9), [out](../../../up.md), [web](https://a.org/x) and [top](#top).'"),
    _cat("'Visit https://host'", _s(f"{K} % 50"), "'.org/wiki/A_(b). Or (see http://10.0.0.'", _s(f"{K} % 9"), "'/x), https://github.com/acme/r'", _s(f"{K} % 20"), "'... also https://api.example.com/'", "chr(36)", "'{id} now.'"),
    _cat("'Install '", "chr(96)", "'left-pad'", _s(f"{K} % 12"), "chr(96)", "', '", "chr(96)", "'@scope/pkg'", _s(f"{K} % 8"), "chr(96)", "', '", "chr(96)", "'github.com/acme/lib'", _s(f"{K} % 6"), "chr(96)", "', '", "chr(96)", "'true'", "chr(96)", "' and '", "chr(96)", "'react'", "chr(96)", "'.'"),
    *_CODE,
    "'## Layout'",
    _cat("'The function returns a '", "p_type", "' of the API.'"),
    *_TREE,
    "'### Tools'",
    *_PY,
    *_GO,
    "'End.'",
)
_RST = _text("'Title'", "'====='", _cat("'Read '", "chr(96)", "'Config <../mod'", _s(f"{K} % 60"), "'.rst>'", "chr(96)", "'_ and https://host'", _s(f"{K} % 50"), "'.org/;'"), _cat("'Python 3.'", _s(f"{K} % 12"), "' and Django '", _s(f"{K} % 5"), "'.x'"), "'.. code-block::'", "''", "'   top'", _cat("'   ├── a'", _s(f"{K} % 5"), "'.py'"), "'   └── b.py'", "'End'")
_ADOC = _text("'= Title'", _cat("'link:./conf'", _s(f"{K} % 9"), "'.adoc[Configuration] Redis 7.0'"), "'----'", "'app'", _cat("'|-- x'", _s(f"{K} % 5"), "'.rb'"), "'----'")
DOCS = f"""
SELECT {K} AS id,
  CASE WHEN {K} % 10 = 8 THEN 'docs/rst/p' || {_s(K)} || '.rst' WHEN {K} % 10 = 9 THEN 'docs/adoc/p' || {_s(K)} || '.adoc'
    ELSE 'docs/g' || {_s(f'{K} % 7')} || '/p' || {_s(K)} || '.md' END AS path,
  CASE WHEN {K} % 10 = 8 THEN 'restructuredtext' WHEN {K} % 10 = 9 THEN 'asciidoc' ELSE 'markdown' END AS format,
  CASE WHEN {K} % 10 = 8 THEN {_RST} WHEN {K} % 10 = 9 THEN {_ADOC} ELSE {_MD} END AS content
FROM part
"""

J = "s_suppkey"
_TS = _text(
    "'// Settings of the module, see http://a.b'",
    _cat("'/** Block comment number '", _s(J), "' of this file */'"),
    _cat("'export interface Options'", _s(J), "' {'"),
    "'  size: number;'",
    "'  readonly color?: string;'",
    "'  nested: {'",
    "'    deep: number;'",
    "'  };'",
    "'}'",
    _cat("'export type Alias'", _s(J), "' = {'"),
    "'  first: number;'",
    "'}'",
    _cat("'export class Gadget'", _s(J), "' {}'"),
    _cat("'export async function makeThing'", _s(J), "'(alpha: string, beta?: Map<string, number>, ...rest: any[]) { return 1 }'"),
    _cat("'const makePair'", _s(J), "' = (left, right = 2) => left'"),
    _cat("'export const Limit'", _s(J), "' = 3;'"),
    _cat("'export { helperA, Helper'", _s(f"{J} % 9"), "' as Renamed }'"),
    "'export default makeDefault;'",
)
_PYS = _text("'# run the tools'", "'\"\"\"Docstring of a module that explains it\"\"\"'", "'def run_all(items, limit=3):'", "'    pass'", "'async def _hidden(x):'", _cat("'class Engine'", _s(J), "':'"), "'    def start(self, fast, *args):'", "'        pass'", "'LIMIT = 3'")
_GOS = _text("'// Build makes it'", _cat("'func Build'", _s(J), "'(n int) error { return nil }'"), _cat("'type Store'", _s(J), "' struct {'"), "'}'", "'func (s *Store) Close() {}'")
CODE = f"""
SELECT CASE WHEN {J} % 5 = 3 THEN 'pkg/tool' || {_s(J)} || '.py' WHEN {J} % 5 = 4 THEN 'cmd/main' || {_s(J)} || '.go' ELSE 'src/mod' || {_s(J)} || '.ts' END AS path,
  CASE WHEN {J} % 5 = 3 THEN 'python' WHEN {J} % 5 = 4 THEN 'go' ELSE 'typescript' END AS language,
  CASE WHEN {J} % 5 = 3 THEN {_PYS} WHEN {J} % 5 = 4 THEN {_GOS} ELSE {_TS} END AS content
FROM supplier
"""

_PKG = "'{\"engines\": {\"node\": \">=18.2.0\", \"npm\": \"9.x\"}, \"dependencies\": {\"react\": \"^18.2.0\", \"left-pad3\": \"1.x\", \"@scope/pkg1\": \"~2.0.1\"}, \"devDependencies\": {\"TypeScript\": \"5.3.2\", \"react\": \"^17.0.1\"}, \"peerDependencies\": {\"left-pad5\": \"*\"}}'"
MANIFESTS = f"""
SELECT 0 AS ord, 'package.json' AS name, {_PKG} AS content FROM region WHERE r_regionkey = 0
UNION ALL SELECT 1, 'requirements.txt', {_text("'flask>=2.0.1'", "'requests==2.31.0'", "'# comment'", "'django'", "''")} FROM region WHERE r_regionkey = 1
UNION ALL SELECT 2, 'pyproject.toml', {_text("'[project]'", "'name = \"x\"'", "'[project.dependencies]'", "'\"numpy>=1.26\",'", "'\"pandas\"'", "'[tool]'")} FROM region WHERE r_regionkey = 1
UNION ALL SELECT 3, 'go.mod', {_text("'module example.com/m'", "'go 1.21'", "'require ('", "'  github.com/acme/lib1 v1.9.1'", "'  github.com/acme/lib2 v0.3.0'", "')'")} FROM region WHERE r_regionkey = 2
UNION ALL SELECT 4, 'Cargo.toml', {_text("'[package]'", "'[dependencies]'", "'serde = \"1.0\"'", "'tokio = { version = \"1.35\" }'")} FROM region WHERE r_regionkey = 3
UNION ALL SELECT 5, 'pom.xml', '<project><artifactId>own</artifactId><java.version>17</java.version><dependency><groupId>g</groupId><artifactId>Spring-Core</artifactId><version>6.1.2</version></dependency></project>' FROM region WHERE r_regionkey = 4
"""

COMMITS = f"""
SELECT md5(cast(event_id AS string)) AS hash, ts, event_type AS message, event_id AS seq,
  CASE WHEN user_id % 3 = 0 THEN 'docs/g' || cast(user_id % 7 AS string) || '/p' || cast(user_id % 210 AS string) || '.md' ELSE 'src/mod' || cast(user_id % 90 AS string) || '.ts' END AS path
FROM events
"""

URLS = f"""
SELECT page_id, url FROM pages
UNION ALL SELECT page_id, 'http://10.0.0.' || {_s('page_id % 300')} || '/x' FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT page_id, 'https://172.' || {_s('10 + page_id % 30')} || '.1.2/y' FROM pages WHERE page_id % 5 = 1
UNION ALL SELECT page_id, 'https://docs.corp.org/{{{{' || 'name' || '}}}}' FROM pages WHERE page_id % 10 = 2
UNION ALL SELECT page_id, 'ftp://files.org/' || {_s('page_id')} FROM pages WHERE page_id % 10 = 3
UNION ALL SELECT page_id, 'https://github.com/acme/r' || {_s('page_id')} FROM pages WHERE page_id % 10 = 4
UNION ALL SELECT page_id, 'https://host' || {_s('page_id')} || '.org/ok' FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'http://localhost:3000/' FROM pages WHERE page_id % 50 = 7
UNION ALL SELECT page_id, 'not a url' FROM pages WHERE page_id % 50 = 8
"""

PROBES = """
SELECT url, max(CASE page_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN 401 WHEN 4 THEN 404 WHEN 5 THEN 204 WHEN 6 THEN 403 ELSE 301 END) AS status
FROM urls GROUP BY url
"""

STATE = "SELECT doc_id AS path, md5(CASE WHEN doc_id % 4 = 0 THEN text || 'x' ELSE text END) AS md5 FROM documents WHERE doc_id % 5 <> 1"

SQL = {"docs_syn": DOCS, "code_syn": CODE, "manifests_syn": MANIFESTS, "commits_syn": COMMITS, "urls": URLS, "probe_results": PROBES, "hash_state": STATE}


def with_corpora(sql: str) -> str:
    """A query with the corpora that it names put before it, for DuckDB."""
    used: list[str] = []

    def need(text: str) -> None:
        for name, body in SQL.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                need(body)
                used.append(name)

    need(sql)
    heads = [f"{name} AS MATERIALIZED ({SQL[name]})" for name in used]
    sql = sql.strip()
    if sql.lower().startswith("with recursive"):
        return "WITH RECURSIVE " + ",\n".join([*heads, sql[len("with recursive") :].strip()])
    if sql.lower().startswith("with"):
        return "WITH " + ",\n".join([*heads, sql[4:].strip()])
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + sql


#: Bytes of a table of short rows that one task composes texts of: some thousand rows.
SPREAD = 32 << 10
#: Tables whose few bytes a row become whole texts, with their keys.
SHORT_ROWS = {"part": "p_partkey", "supplier": "s_suppkey"}


def spread(table: DataFrame, key: str) -> DataFrame:
    """The rows dealt over tasks by their key: a small file is one split, but its texts are hundreds of times as large."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(max(table.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD)), key)


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus, or a table of the driver, as a DataFrame; nothing is registered."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = SQL[name]
    frames = {t: corpus(spark, sf_dir, t) for t in [*TABLES, *SQL] if t != name and re.search(rf"\bFROM {t}\b", body)}
    frames |= {t: spread(frames[t], key) for t, key in SHORT_ROWS.items() if t in frames}
    # braces of the text are doubled, those of the tables single, as the formatter of spark.sql reads them
    named = re.sub(rf"\bFROM ({'|'.join(frames)})\b", r"FROM {\1}", body.replace("{", "{{").replace("}", "}}"))
    return spark.sql(named, **frames)
