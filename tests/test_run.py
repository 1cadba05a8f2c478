import json
import subprocess

import pytest

from weftline import cli, config
from weftline.plans.check import Check, run
from weftline.plugins import Plugin
from weftline.streaming import continuous

DOC = """# Guide
See [a](./src/app.ts), [gone](./src/ap.ts) and https://example.com/x.
React 17.0 with `react` and `left-pad`.
```ts
import { start } from './app'
start(1, 2)
class AppThing {}
```
"""


@pytest.fixture
def project(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "README.md").write_text(DOC)
    (tmp_path / "src" / "app.ts").write_text("export function start(one: number) {}\nexport class AppThing {}\n")
    (tmp_path / "package.json").write_text('{"dependencies": {"react": "^18.2.0"}}')
    for args in (["init", "-q"], ["add", "."], ["-c", "user.email=a@b.c", "-c", "user.name=n", "commit", "-qm", "first"]):
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True)
    return tmp_path


def settings(project, **over):
    return config.override(config.load(None, str(project)), {"skip_urls": True} | over)


def quiet(project, **over):
    """Only versions are checked."""
    out = settings(project, only="version", **over)
    out["rules"]["code-snippet"] = {"enabled": False}
    out["graph"]["enabled"] = False
    return out


def test_a_whole_run(spark, project):
    check = run(spark, settings(project, score=True, reporter="json"))
    rows = {(r.type, r.value): r for r in check.results.collect()}
    assert rows["file-path", "./src/app.ts"].valid and rows["file-path", "./src/ap.ts"].suggestion == "Did you mean: app.ts?"
    assert not rows["version", "React 17.0"].valid and rows["dependency", "left-pad"].severity == "info"
    assert rows["external-url", "https://example.com/x"].skipped and rows["code-pattern", "AppThing"].valid
    assert rows["code-snippet", "start"].message == "Function start called with 2 arg(s) but expects 1" and rows["code-snippet", "./app"].valid
    assert check.summary["errors"] == 1
    out = json.loads(check.report()["json"])
    assert out["summary"] == check.summary and out["documents"][0]["path"] == "README.md" and out["scores"]["total"] == 1
    for name in ("markdown", "console", "enhanced"):
        check.config["reporters"] = [name]
        assert "README.md" in check.report()[name]
    assert (project / ".weftline-cache" / "edges").is_dir()


def test_disabled_rules_are_counted_as_skipped(spark, project):
    check = Check(spark, quiet(project))
    assert check.summary["errors"] == 0 and check.summary["skipped"] > 5 and {r.type for r in check.issues.collect()} == {"version"}


def test_incremental(spark, project):
    first = run(spark, quiet(project, incremental=True))
    assert first.documents.count() == 1
    first.close()
    again = run(spark, quiet(project, incremental=True))
    assert again.documents.count() == 0 and again.summary["total"] == 0
    again.close()
    (project / "README.md").write_text(DOC + "more")
    assert Check(spark, quiet(project, incremental=True)).documents.count() == 1


def test_plugins(spark, project):
    class Todo(Plugin):
        def extractors(self):
            from pyspark.sql import functions as F

            from weftline.functions.text import occurrences

            return {"todo": lambda d: occurrences(d, "content", r"# \w+").select("path", F.lit("todo").alias("type"), F.col("raw").alias("value"), "line", "raw", "start")}

        def validators(self):
            from pyspark.sql import functions as F

            none = lambda: F.lit(None).cast("string")
            return {"todo": lambda r: r.withColumns({"valid": F.lit(False), "skipped": F.lit(False), "severity": F.lit("warning"), "message": F.lit("todo"), "suggestion": none()})}

    check = Check(spark, quiet(project), plugins=[Todo("todo")])
    assert [r.value for r in check.issues.where("type = 'todo'").collect()] == ["# Guide"]


def test_cli(spark, project, capsys):
    (project / "weftline.config.json").write_text('{"rules": {"code-snippet": {"enabled": false}}, "graph": {"enabled": false}}')
    target = project / "out" / "report.md"
    options = ["--root", str(project), "--skip-urls", "--no-cache"]
    assert cli.main([*options, "--only", "file-path"], spark) == 1
    assert "File not found: ./src/ap.ts" in capsys.readouterr().out
    assert cli.main([*options, "--only", "version", "-r", "markdown", "-o", str(target)], spark) == 0
    assert "Version mismatch" in target.read_text()
    (project / "bad.json").write_text("[1]")
    assert cli.main(["--root", str(project), "-c", str(project / "bad.json")], spark) == 1


def test_config(tmp_path):
    assert config.merge({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2]}, "d": None}) == {"a": {"b": 1, "c": [2]}, "d": None}
    (tmp_path / "web" / "src").mkdir(parents=True)
    (tmp_path / "web" / "src" / "a.ts").write_text("")
    (tmp_path / "tool").mkdir()
    (tmp_path / "tool" / "b.py").write_text("")
    (tmp_path / "weftline.config.json").write_text('{"rules": {"version": {"severity": "error"}}}')
    got = config.load(None, str(tmp_path))
    assert got["source_patterns"] == [f"tool/{config.SOURCE_GLOB}", f"web/src/{config.SOURCE_GLOB}"]
    assert got["rules"]["version"] == {"enabled": True, "severity": "error"} and config.DEFAULTS["rules"]["version"]["severity"] == "warning"
    got["cache"]["dir"] = "../outside"
    with pytest.raises(ValueError):
        config.cache_dir(got)


def test_stream(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("React 17")
    (docs / "b.txt").write_text("React 18")
    from weftline.operators import extract

    def go():
        stream = continuous.document_stream(spark, str(docs), ["*.md"])
        continuous.check_stream(stream, lambda d: extract.versions(d).select("path", "version"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return {(r.path, r.version) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert go() == {("a.md", "17")}
    (docs / "c.md").write_text("React 19")
    assert go() == {("a.md", "17"), ("c.md", "19")}


def test_every_file_is_seen(spark, tmp_path):
    """Hidden and underscored names, empty files and empty directories are there like others."""
    from weftline.sources import files

    made = {"README.md": "hi é", "docs/_index.md": "x", "docs/.hidden.md": "", "src/__init__.py": "", "src/_private/deep/er/mod.py": "a = 1", ".github/workflows/ci.yml": "on: push", "a b+c%20.md": "odd"}
    for path, content in made.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    (tmp_path / "empty" / "er").mkdir(parents=True)
    (tmp_path / "broken.md").write_bytes(b"ok \xff")
    listed = {r.path: r.is_file for r in files.tree(spark, str(tmp_path)).collect()}
    assert {p for p, f in listed.items() if f} == {*made, "broken.md"} and {"empty", "empty/er", "src/_private/deep", ".github"} <= listed.keys()
    docs = {r.path: r.content for r in files.documents(spark, f"file://{tmp_path}", ["**/*.md"], ["broken.md"]).collect()}
    assert docs == {p: c for p, c in made.items() if p.endswith(".md")}
    code = sorted((r.path, r.content, r.pattern_ord) for r in files.code_files(spark, str(tmp_path), ["**/*.py", "src/*.py"]).collect())
    assert code == [("src/__init__.py", "", 0), ("src/__init__.py", "", 1), ("src/_private/deep/er/mod.py", "a = 1", 0)]
    assert [r.content for r in files.documents(spark, str(tmp_path), ["broken.md"]).collect()] == ["ok �"]
    assert "" in {r.path for r in files.listing(files.tree(spark, str(tmp_path)).select("path")).collect()}
    links = "[a](./docs/_index.md) [b](./src/__init__.py) [c](./.github/workflows/ci.yml) [d](./empty) [e](./docs/.hidden.md) [f](./gone.md)"
    (tmp_path / "README.md").write_text(links)
    check = run(spark, settings(tmp_path))
    assert {r.value for r in check.results.collect() if r.type == "file-path" and not r.valid} == {"./gone.md"}


def test_embeddings_are_kept(spark, project):
    """A second run asks the model for nothing that the first has embedded, and finds the saved graph."""
    (project / "README.md").write_text(DOC + "\n## Start\n" + "The function start begins the work and returns a class. " * 4)
    (project / "src" / "app.ts").write_text("/** Starts the application and returns nothing at all, as the guide says. */\nexport function start(one: number) {}\n")

    def model(texts):
        return [[float(len(t)), 1.0] for t in texts]

    def broken(texts):
        raise AssertionError("asked again")

    config_ = quiet(project) | {"semantic": {"enabled": True, "similarity_threshold": 0.99}}
    first = Check(spark, config_, model=model)
    assert first.mismatches is not None and first.embeddings.count() >= 2
    first.config["graph"]["enabled"] = True
    first.save_state()
    rows = {(r.key, tuple(r.embedding)) for r in first.embeddings.collect()}
    again = Check(spark, config_, model=broken)
    assert {(r.key, tuple(r.embedding)) for r in again.embeddings.collect()} == rows and again.mismatches.count() == first.mismatches.count()
    assert again.saved_graph() is not None and again.saved_graph().count() == first.edges.count()
    other = Check(spark, config_ | {"include": ["docs/**"]}, model=broken)
    assert other.saved_graph() is None
