import pytest

from weftline.operators import extract, index, snippets
from weftline.sources import files, manifests

T = "`" * 3


def docs(spark, *rows):
    return spark.createDataFrame([(f"d{i}.md", f, c) for i, (f, c) in enumerate(rows)], "path string, format string, content string")


def code(spark, *rows):
    return spark.createDataFrame([(f"f{i}", lang, c) for i, (lang, c) in enumerate(rows)], "path string, language string, content string")


def values(df, col="value", order=("path", "start")):
    return [r[col] for r in df.orderBy(*order).collect()]


def test_file_links(spark):
    df = docs(spark, ("markdown", "[a](./config/loader.ts) [b](../README.md) [c](https://x.org) [d](#h) [e](a.test.ts) [f](../s/f.ts:26-38) [g](../s/f.ts#L123)"), ("restructuredtext", "`Configuration <../config.rst>`_"), ("asciidoc", "link:./config.adoc[Configuration]"), ("plaintext", None))
    rows = extract.file_links(df).orderBy("path", "start").collect()
    assert [(r.value, r.line_ref) for r in rows] == [("./config/loader.ts", None), ("../README.md", None), ("../s/f.ts", "26-38"), ("../s/f.ts", "123"), ("../config.rst", None), ("./config.adoc", None)]


@pytest.mark.parametrize("text, url", [("https://example.com/path...", "https://example.com/path"), ("(visit https://example.com)", "https://example.com"), ("(see (https://example.com))", "https://example.com"), ("https://en.wiki.org/A_(b)", "https://en.wiki.org/A_(b)"), ("x https://a.b/c?!,;:", "https://a.b/c")])
def test_urls(spark, text, url):
    assert values(extract.urls(docs(spark, ("markdown", text)))) == [url]


def test_versions(spark):
    df = docs(spark, ("markdown", "Node.js 18.0.0 and TypeScript 5.0, React v18.2.0; Python 3.x PostgreSQL 16\nVersion 1.0.0 of something, Node 18"))
    assert [(r.technology, r.version) for r in extract.versions(df).orderBy("start").collect()] == [("Node.js", "18.0.0"), ("TypeScript", "5.0"), ("React", "18.2.0"), ("Python", "3.x"), ("PostgreSQL", "16")]


def test_trees(spark):
    tree = "src\n├── index.ts\n├── utils/\n│   └── helper.ts\n└── config/\n    └── defaults.ts\n"
    df = docs(spark, ("markdown", f"x\n{T}\n{tree}{T}\n"), ("markdown", f"{T}\nab\n└── long-name.ts\n...\n---\n{T}"), ("markdown", f"{T}\nno tree\n{T}"))
    rows = extract.trees(df).orderBy("path", "entry").collect()
    assert [r.value for r in rows] == ["src", "src/index.ts", "src/utils", "src/utils/helper.ts", "src/config", "src/config/defaults.ts", "ab/long-name.ts"]
    assert {r.line for r in rows if r.path == "d0.md"} == {2}


def test_code_symbols(spark):
    df = docs(spark, ("markdown", f"{T}ts\nclass UserThing {{}}\ninterface Props {{}}\n{T}\n{T}python\nclass Engine:\n  def run_it(self): pass\n{T}\n{T}go\ntype Store struct {{}}\n{T}"))
    assert {(r.kind, r.value, r.line) for r in extract.code_symbols(df).collect()} == {("class", "UserThing", 1), ("interface", "Props", 1), ("class", "Engine", 5), ("function", "run_it", 5), ("struct", "Store", 9)}


def test_packages(spark):
    df = docs(spark, ("markdown", "`@types/node` `express` `github.com/gin-gonic/gin` `true` `config` `ab`"))
    assert sorted(values(extract.packages(df))) == ["@types/node", "express", "github.com/gin-gonic/gin"]
    assert values(extract.packages(df, ("go",))) == ["github.com/gin-gonic/gin"]


def test_sections(spark):
    rows = extract.sections(docs(spark, ("markdown", "intro\n# One\na\nb\n## Two\n\nc"))).orderBy("ord").collect()
    assert [(r.heading, r.text) for r in rows] == [("Introduction", "intro"), ("One", "a\nb"), ("Two", "c")]


SNIPPET = f"""{T}ts
import client, {{ createUser as make, deleteUser }} from './services'
import * as all from '../all'
const config = require('./config')
createUser(name, email)
initialize()
processData(transform(input), callback(x))
call(
  a,
  b,
  c,
)
obj.method(q); function skipMe(a) {{}}
const opts: AppConfig = {{
  db: {{ host, port }},
  cache
}}
{T}"""


def test_snippets(spark):
    rows = snippets.snippets(docs(spark, ("markdown", SNIPPET))).orderBy("step", "start").collect()
    by = {r.value: r for r in rows}
    assert by["./services"].link_text == "client,createUser,deleteUser" and by["./services"].import_specifiers == ["default:client", "named:createUser", "named:deleteUser"]
    assert by["../all"].import_specifiers == ["namespace:all"] and by["./config"].import_specifiers == ["module:*"] and by["./config"].link_text == ""
    assert by["createUser"].link_text == "2" and by["createUser"].argument_names == ["name", "email"]
    assert by["initialize"].link_text == "0" and by["initialize"].argument_names == []
    assert by["processData"].link_text == "2" and by["processData"].argument_names is None
    assert by["call"].link_text == "3" and "method" not in by and "skipMe" not in by
    assert by["db,cache"].link_text == "AppConfig" and by["./services"].line == 1


def test_indexes(spark):
    ts = "export interface Opts extends Base {\n  a: number;\n  readonly b?: string;\n  n: {\n    deep: 1;\n  };\n}\nexport function go(x, y?: Map<string, number>, z = 1) {}\nconst arrow = async (p, q = () => 1) => p\nexport { one as two }\nexport default main;\nmodule.exports = { k1, k2: v }\n/** Doc of it */\nclass Thing {}\n"
    py = "def open_(a, b=1, *c):\n    pass\nclass K:\n    def m(self, x): pass\n_hid = 1\nLIM = 2\n"
    df = code(spark, ("typescript", ts), ("python", py))
    assert {r.symbol for r in index.exports(df).where("path = 'f0'").collect()} == {"Opts", "go", "one", "main", "default", "k1", "k2"}
    assert {r.symbol for r in index.exports(df).where("path = 'f1'").collect()} == {"open_", "K", "LIM"}
    sigs = {r["name"]: (r.params, r.required) for r in index.signatures(df).collect()}
    assert sigs["go"] == (["x", "y", "z"], 1)
    assert sigs["open_"] == (["a", "b", "c"], 1) and sigs["m"] == (["x"], 1)
    assert {(r.type_name, r.key) for r in index.interface_keys(df).collect()} == {("Opts", "a"), ("Opts", "b"), ("Opts", "n")}
    assert {(r.text, r.symbol) for r in index.comments(df).collect()} == {("Doc of it", "Thing")}
    assert {r.symbol for r in index.symbols(df).collect()} == {"Opts", "Thing", "go", "open_", "m"}


def test_formats_and_languages(spark):
    names = [(x,) for x in "a.md a.markdown a.rst a.adoc a.asciidoc a.txt a.unknown a.MD".split()]
    df = spark.createDataFrame(names, "p string")
    got = [r[0] for r in df.select(files.format_of(df.p)).collect()]
    assert got == ["markdown", "markdown", "restructuredtext", "asciidoc", "asciidoc", "plaintext", "plaintext", "markdown"]
    other = spark.createDataFrame([("x.PY",), ("x.rs",), ("x",)], "p string")
    assert [r[0] for r in other.select(index.language_of(other.p)).collect()] == ["python", "rust", "javascript"]


def test_manifests(spark):
    rows = [
        (0, "package.json", '{"engines": {"node": "^18.0.0", "npm": ">=9.0.0"}, "dependencies": {"express": "~4.18.0", "Zod": "3.x"}, "devDependencies": {"express": "5.0.0"}, "peerDependencies": {"peer": "1"}}'),
        (1, "requirements.txt", "requests==2.31.0\n# comment\ndjango\nflask>=2.0.1"),
        (2, "go.mod", "module m\ngo 1.21\nrequire (\n github.com/a/b v1.2.3\n)"),
        (3, "Cargo.toml", '[dependencies]\nserde = "1.0"\n'),
        (4, "pom.xml", "<artifactId>own</artifactId><java.version>17</java.version>"),
        (5, "package.json", "broken"),
        (6, "other", "x"),
    ]
    df = spark.createDataFrame(rows, "ord int, name string, content string")
    got = {r["name"]: r.version for r in manifests.effective_versions(df).collect()}
    assert got == {"node": "18.0.0", "nodejs": "18.0.0", "npm": "9.0.0", "express": "5.0.0", "zod": "3.0", "flask": "2.0.1", "requests": "2.31.0", "django": "any", "go": "1.21", "golang": "1.21", "github.com/a/b": "1.2.3", "serde": "1.0", "java": "17"}
    assert {r["name"] for r in manifests.dependencies(df).collect()} == {"express", "zod", "peer", "flask", "requests", "django", "github.com/a/b", "serde", "own"}
