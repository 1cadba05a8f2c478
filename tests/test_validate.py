import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, history, score, semantic, state, validate
from weftline.sources import files

ROOT = "/project"


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


@pytest.fixture
def listing(spark):
    paths = ["docs/guide.md", "src/helper.ts", "src/index.ts", "src/utils/format.ts", "package.json", "lib/Hooks.ts"]
    return files.listing(frame(spark, "path string", *[(p,) for p in paths]))


def test_listing_has_ancestors(listing):
    assert {r.path for r in listing.collect()} >= {"", "docs", "src", "src/utils", "src/utils/format.ts"}


def test_file_paths(spark, listing):
    refs = frame(spark, "path string, value string", *[("docs/guide.md", v) for v in ["../src/helper.ts", "../src/helpr.ts", "../src", "../../up.md", "../src/foo.ts", "/project/package.json", "../nodir/x.ts"]])
    got = {r.value: r for r in validate.file_paths(refs, listing, ROOT).collect()}
    assert got["../src/helper.ts"].valid and got["../src"].valid and got["/project/package.json"].valid
    assert got["../src/helpr.ts"].suggestion == "Did you mean: helper.ts?" and got["../src/helpr.ts"].severity == "error"
    assert got["../../up.md"].message == "Path escapes project root: ../../up.md" and got["../../up.md"].suggestion is None
    assert got["../src/foo.ts"].skipped and got["../nodir/x.ts"].suggestion is None
    loud = {r.value: r for r in validate.file_paths(refs, listing, ROOT, skip_examples=False).collect()}
    assert loud["../src/foo.ts"].severity == "info" and "(illustrative)" in loud["../src/foo.ts"].message


def test_directories(spark, listing):
    refs = frame(spark, "path string, value string", *[("docs/guide.md", v) for v in ["src/utils", "guide.md", "src/helpers.ts", "lib/hook.ts", "../../x", "zzz/y", "src/INDEX.ts"]])
    got = {r.value: r for r in validate.directories(refs, listing, ROOT).collect()}
    assert got["src/utils"].found_at == "src/utils" and got["guide.md"].found_at == "docs/guide.md"
    assert got["src/helpers.ts"].suggestion == "src/helper.ts" and got["lib/hook.ts"].suggestion == "lib/Hooks.ts" and got["src/INDEX.ts"].suggestion == "src/index.ts"
    assert got["../../x"].message.startswith("Path escapes") and got["zzz/y"].suggestion is None


def test_versions(spark):
    refs = frame(spark, "technology string, version string", ("React", "17.0"), ("React", "18"), ("nodejs", "16"), ("Node.js", "16"), ("Go", "1.20"), ("Vue", "3"), ("Vite", "5"))
    packages = frame(spark, "name string, version string", ("react", "18.2.0"), ("node", "18.0.0"), ("go", "1.21"), ("vue", "any"))
    got = {(r.technology, r.version): r for r in validate.versions(refs, packages).collect()}
    assert got["React", "17.0"].message == "Version mismatch: doc says React 17.0, actual is 18.2.0" and got["React", "17.0"].suggestion == "Update to React 18.2.0"
    assert got["React", "18"].valid and got["Go", "1.20"].valid and not got["nodejs", "16"].valid
    assert got["Node.js", "16"].message == "Could not find node.js in dependencies" and got["Vue", "3"].valid and got["Vite", "5"].valid


def test_symbols_and_packages(spark):
    index = frame(spark, "symbol string, file_path string, kind string, language string, pattern int, start int", ("UserService", "src/b.ts", "class", "typescript", 0, 1), ("UserService", "src/a.ts", "class", "typescript", 0, 1))
    refs = frame(spark, "value string, kind string", ("UserService", "class"), ("UserServce", "class"), ("MyThing", "class"), ("Nothing", "type"))
    got = {r.value: r for r in validate.symbols(refs, index).collect()}
    assert got["UserService"].found_in == ["src/a.ts", "src/b.ts"] and got["UserServce"].suggestion == "Did you mean: UserService?"
    assert got["MyThing"].skipped and got["Nothing"].message == "Code pattern not found: type Nothing"
    deps = validate.packages(frame(spark, "value string", ("React",), ("left-pad",)), frame(spark, "name string", ("react",)))
    assert {r.value: (r.valid, r.severity) for r in deps.collect()} == {"React": (True, None), "left-pad": (False, "info")}


def test_urls(spark):
    hosts = ["10.0.0.1", "172.16.0.1", "172.31.255.255", "192.168.1.1", "169.254.1.1", "224.0.0.1", "255.255.255.255", "127.0.0.2", "0.0.0.0", "[::1]", "[fd00::1]"]
    status = {"https://ok.org/": 200, "https://auth.org/": 401, "https://deny.org/": 403, "https://github.com/a/b": 404, "https://gone.org/": 404, "https://bad.org/": 500}
    odd = ["https://x.org/${id}", "https://x.org/{{a}}", "ftp://x.org/", "not a url", "https://sub.example.com/", "https://slow.org/", "https://dead.org/", "https://cached.org/"]
    urls = frame(spark, "url string", *[(f"http://{h}/x",) for h in hosts], *[(u,) for u in [*status, *odd]])
    probes = frame(spark, "url string, status int, error string, timed_out boolean", *[(u, s, None, False) for u, s in status.items()], ("https://slow.org/", None, None, True), ("https://dead.org/", None, "refused", False), ("https://cached.org/", 500, None, False))
    cache = frame(spark, "url string, valid boolean, severity string, message string, status_code int, ts_ms long", ("https://cached.org/", True, None, None, 200, 9_000_000), ("https://ok.org/", False, "warning", "old", 500, 1))
    got = {r.url: r for r in validate.url_verdicts(urls, probes, cache, now_ms=10_000_000).collect()}
    assert all(got[f"http://{h}/x"].skipped for h in hosts)
    assert got["https://ok.org/"].valid and got["https://ok.org/"].status_code == 200 and got["https://cached.org/"].valid
    assert got["https://auth.org/"].message == "Requires authentication: https://auth.org/" and got["https://deny.org/"].valid
    assert got["https://github.com/a/b"].message.startswith("May be private") and not got["https://gone.org/"].valid and not got["https://bad.org/"].valid
    assert got["https://x.org/${id}"].skipped and got["https://x.org/{{a}}"].skipped and got["https://sub.example.com/"].message == "Domain in skip list"
    assert got["ftp://x.org/"].message == "Unsupported URL protocol: ftp:" and got["not a url"].message.startswith("Invalid URL format")
    assert got["https://slow.org/"].message.startswith("URL timeout") and got["https://dead.org/"].message == "URL check failed: https://dead.org/ (refused)"
    asked = {r.url: r.method for r in validate.to_probe(urls.union(frame(spark, "url string", ("https://docs.microsoft.com/x",))), cache, 10_000_000).collect()}
    assert asked["https://docs.microsoft.com/x"] == "GET" and asked["https://gone.org/"] == "HEAD" and "https://cached.org/" not in asked


def test_imports(spark):
    code = frame(spark, "path string, language string, content string", ("src/services.ts", "typescript", ""), ("lib/util/index.ts", "typescript", ""), ("pkg/tool.py", "python", ""))
    listing = files.listing(code.select("path").union(frame(spark, "path string", ("assets/data",))))
    exports = frame(spark, "path string, symbol string", ("src/services.ts", "createUser"), ("src/services.ts", "default"), ("lib/util/index.ts", "go"))
    refs = frame(spark, "value string, language string, import_specifiers array<string>, link_text string", ("./services", "typescript", ["named:createUser", "default:x"], ""), ("./services", "typescript", ["named:createUsr"], "q"), ("./util", "typescript", ["default:y"], ""), ("pkg.tool", "python", None, None), ("numpy", "python", None, None), ("./servce", "typescript", ["module:*"], ""), ("./serv", "typescript", [], ""), ("./foo", "typescript", [], ""))
    got = {(r.value, tuple(r.import_specifiers or ())): r for r in validate.imports(refs, code, listing, exports).collect()}
    assert got["./services", ("named:createUser", "default:x")].valid
    assert got["./services", ("named:createUsr",)].suggestion == "Did you mean: createUsr → createUser?"
    assert got["./util", ("default:y",)].message == "Symbol(s) not exported from lib/util/index.ts: y"
    assert got["pkg.tool", ()].resolved_path == "pkg/tool.py" and got["numpy", ()].skipped
    assert got["./servce", ("module:*",)].suggestion is None and got["./serv", ()].suggestion == "Did you mean: src/services.ts?" and got["./foo", ()].skipped


def test_calls_and_keys(spark):
    sigs = frame(spark, "name string, params array<string>, required int, file_path string, pattern int, start int", ("findSimilar", ["target", "candidates", "maxDistance"], 2, "a.ts", 0, 0), ("createUser", ["name", "email", "role"], 2, "b.ts", 0, 0))
    refs = frame(spark, "value string, link_text string, argument_names array<string>", ("findSimilar", "2", None), ("findSimilar", "3", None), ("findSimilar", "5", None), ("createUser", "2", ["username", "email"]), ("createUser", "2", ["name", "email"]), ("unknownFn", "1", None), ("ab", "1", None))
    got = {(r.value, r.link_text, tuple(r.argument_names or ())): r for r in validate.calls(refs, sigs).collect()}
    assert got["findSimilar", "2", ()].valid and got["findSimilar", "3", ()].valid
    assert got["findSimilar", "5", ()].message == "Function findSimilar called with 5 arg(s) but expects 2–3"
    assert got["createUser", "2", ("username", "email")].suggestion == "Current signature: createUser(name, email, role)"
    assert got["createUser", "2", ("name", "email")].valid and got["unknownFn", "1", ()].skipped and got["ab", "1", ()].skipped
    keys = frame(spark, "type_name string, key string", ("Opts", "color"), ("Opts", "size"))
    refs = frame(spark, "value string, link_text string", ("color,size", "Opts"), ("colr", "Opts"), ("x", "Other"), ("x", None))
    got = {(r.value, r.link_text): r for r in validate.config_keys(refs, keys).collect()}
    assert got["color,size", "Opts"].valid and got["colr", "Opts"].suggestion == "Did you mean: colr → color?" and got["x", "Other"].skipped and got["x", None].skipped


def results(spark, *rows):
    return frame(spark, "path string, type string, value string, line int, valid boolean, skipped boolean, severity string, message string, suggestion string", *[(p, "t", "v", i, ok, skip, sev, "m", None) for i, (p, ok, skip, sev) in enumerate(rows)])


def test_summary_and_validity(spark):
    r = results(spark, ("a", True, False, None), ("a", False, False, "error"), ("a", False, False, "warning"), ("b", True, True, None), ("b", False, False, "info"))
    assert score.summary(r).first().asDict() == {"total": 5, "valid": 2, "errors": 1, "warnings": 1, "skipped": 1}
    docs = frame(spark, "path string", ("a",), ("b",), ("c",))
    assert {x.path: x.reference_validity for x in score.validity(docs, r).collect()} == {"a": 67, "b": 100, "c": 100}
    assert score.issues_by_doc(r).count() == 1


def test_scores(spark):
    docs = frame(spark, "path string", *[(f"d{i}",) for i in range(4)])
    pairs = frame(spark, "doc_path string, code_path string", ("d0", "old"), ("d1", "new"), ("d2", "lost"))
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    commits = frame(spark, "hash string, s string, message string, path string", ("1", day(2), "m", "d0"), ("2", day(1), "m", "old"), ("3", day(1), "m", "d1"), ("4", day(31), "m", "new"), ("5", day(31), "n", "new"), ("6", day(1), "m", "d2")).select("hash", F.to_timestamp("s").alias("ts"), "message", "path")
    assert {r.path: r.git_time_delta for r in score.time_delta(docs, pairs, commits).collect()} == {"d0": 100, "d1": 55, "d2": 75, "d3": 50}
    assert {r.path: r.code_change_frequency for r in score.churn(docs, pairs, commits).collect()} == {"d0": 100, "d1": 97, "d2": 100, "d3": 100}
    assert {r.git_time_delta for r in score.time_delta(docs, pairs, None).collect()} == {75}
    assert {r.path: r.hash for r in history.last_commits(commits).collect()}["new"] == "5"
    assert {r.path for r in history.changed_between(commits, "1", "4").collect()} == {"new"}
    symbols = frame(spark, "code_path string, symbol string", ("old", "A"), ("old", "B"), ("old", "C"))
    refs = frame(spark, "path string, type string, value string", ("d0", "code-pattern", "A"), ("d0", "code-pattern", "A"))
    assert {r.path: r.symbol_coverage for r in score.coverage(docs, refs, pairs, symbols).collect()} == {"d0": 33, "d1": 100, "d2": 100, "d3": 100}
    full = [docs.select("path", F.lit(v).cast("long").alias(k)) for k, v in zip(score.WEIGHTS, (100, 75, 75, 100))]
    got = score.doc_scores(docs, full)
    assert {(r.total_score, r.grade) for r in got.collect()} == {(89, "B")}
    assert score.project_score(got).first().project_score == 89
    assert score.project_score(got.limit(0)).first().asDict()["project_grade"] == "A"


def test_graph(spark):
    refs = frame(spark, "path string, type string, value string, line int", ("docs/x.md", "file-path", "../src/a.ts", 1), ("docs/x.md", "code-pattern", "Foo1", 2), ("docs/y.md", "dependency", "z", 1), ("docs/y.md", "file-path", "../src/none.ts", 1))
    index = frame(spark, "symbol string, file_path string, kind string, language string, pattern int, start int", ("Foo1", "src/b.ts", "class", "ts", 0, 0), ("Bar1", "src/a.ts", "class", "ts", 0, 0))
    edges = graph.edges(refs, index, ROOT)
    assert {(r.doc_path, r.code_path) for r in edges.collect()} == {("docs/x.md", "src/a.ts"), ("docs/x.md", "src/b.ts")}
    changed = frame(spark, "path string", ("src/a.ts",), ("src/b.ts",), ("src/c.ts",))
    assert [r.doc_path for r in graph.affected_docs(edges, changed).collect()] == ["docs/x.md"]
    assert graph.code_for_doc(edges).first().code_files == ["src/a.ts", "src/b.ts"]


def test_state(spark):
    docs = frame(spark, "path string, content string", ("a", "1"), ("b", "2"), ("c", "3"))
    old = state.new_state(docs).where("path <> 'c'").withColumn("md5", F.when(F.col("path") == "b", "x").otherwise(F.col("md5")))
    assert {r.path for r in state.changed_docs(docs, old).collect()} == {"b", "c"}
    rows = frame(spark, "t int, k int", (10, 3), (0, 0), (5, 5)).select(state.incremental_stats(F.col("t"), F.col("k")).alias("s")).collect()
    assert [(r.s.skipped, r.s.percent_skipped) for r in rows] == [(7, 70), (0, 0), (0, 0)]
    table = frame(spark, "key string, seq int, v int", ("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("a", 4, 4))
    assert {r.key: r.v for r in state.keep_newest(table, "key", "seq", 2).collect()} == {"b": 2, "c": 3}
    assert state.keep_newest(table, "key", "seq", -1).count() == 4
    meta = frame(spark, "build_ts_ms long, config_hash string, git_commit string", (100, "h", "c1"), (None, "h", "c1"), (100, "other", "c1"), (100, "h", "c2"), (100, None, None))
    assert [r.valid for r in state.graph_is_valid(meta, "h", "c1", 200).collect()] == [True, False, False, False, True]


def test_semantic(spark):
    docs = frame(spark, "doc_id int, embedding array<float>", (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 2.0, 3.0]))
    code = frame(spark, "code_id int, embedding array<float>", (7, [2.0, 0.0]), (6, [4.0, 0.0]), (8, [0.0, 1.0]))
    got = {r.doc_id: (round(r.score, 6), r.code_id) for r in semantic.best_matches(docs, code, block=2).collect()}
    assert got == {1: (1.0, 6), 2: (0.0, None), 3: (0.0, None), 4: (0.0, None), 5: (0.0, None)}
    sections = frame(spark, "doc_id int, text string", (1, "the function"), (2, "a method"), (3, "nothing"))
    assert {r.doc_id for r in semantic.mismatches(sections, semantic.best_matches(docs, code)).collect()} == {2}
    out = semantic.embed(sections, lambda texts: [[float(len(t))] for t in texts]).collect()
    assert [r.embedding for r in out] == [[12.0], [8.0], [7.0]]


def test_four_numbers_are_a_private_host_even_if_too_large(spark):
    urls = frame(spark, "url string", ("http://10.0.0.260/x",), ("https://u@300.1.2.3:80/y",), ("http://8.8.8.8/z",))
    got = {r.url: (r.valid, r.skipped, r.message) for r in validate.url_verdicts(urls, frame(spark, "url string, status int", ("http://8.8.8.8/z", 200))).collect()}
    assert got == {"http://10.0.0.260/x": (True, True, "Skipped: private/internal address"), "https://u@300.1.2.3:80/y": (True, True, "Skipped: private/internal address"), "http://8.8.8.8/z": (True, False, None)}
    assert [r.url for r in validate.to_probe(urls, None, 0).collect()] == ["http://8.8.8.8/z"]
