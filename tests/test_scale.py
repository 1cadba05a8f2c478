"""What keeps the work in proportion to the input, on small tables."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from weftline.functions.text import enclosed, top_level_parts
from weftline.operators import extract, lookup, semantic, snippets
from weftline.sources.corpora import corpus

DIR = "/root/testdata/sf0.001"


def test_near_targets_do_not_meet_farther_candidates(spark, monkeypatch):
    tried, meeting = [], lookup._meeting
    monkeypatch.setattr(lookup, "_meeting", lambda own, given, keys, d: tried.append(d) or meeting(own, given, keys, d))
    names = spark.createDataFrame([(f"p{k}.md", k) for k in range(100, 140)], "candidate string, ord int")
    asked = spark.createDataFrame([("P101.md",), ("p140.md",), ("p1x1.md",)], "target string")
    assert {r.target: r.match for r in lookup.nearest_names(asked, names).collect()} == {"P101.md": "p101.md", "p140.md": "p100.md", "p1x1.md": "p101.md"}
    assert tried == [1]


def test_products_are_held_by_strips():
    rng = np.random.default_rng(1)
    u, w = rng.normal(size=(3000, 8)), rng.normal(size=(3000, 8))
    tracemalloc.start()
    score, at = semantic.nearest(u, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = (u / np.linalg.norm(u, axis=1)[:, None]) @ (w / np.linalg.norm(w, axis=1)[:, None]).T
    assert (at == s.argmax(axis=1)).all() and np.allclose(score, s.max(axis=1)) and peak < s.nbytes / 2


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Scan")


def test_texts_are_dealt_over_tasks(spark):
    for name in ("docs_syn", "code_syn"):
        assert corpus(spark, DIR, name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_one_scan_for_all_patterns(spark):
    docs = spark.createDataFrame([("a.md", "markdown", "x")], "path string, format string, content string")
    code = snippets.blocks(docs)
    assert [scans(x) for x in (extract.file_links(docs), extract.trees(docs), snippets.imports(code), snippets.config_keys(code))] == [1, 1, 1, 1]


def test_texts_that_hold_the_marks(spark):
    text = "\x02\x01\x02`lib-a`\x01\x01\x03\n\x03\x01\x03`lib-b`\x02\x01\x01"
    docs = spark.createDataFrame([("a.md", "markdown", text), ("b.md", "markdown", "`lib-c`")], "path string, format string, content string")
    got = sorted((r.path, r.value, r.line, r.start, r.raw) for r in extract.packages(docs).collect())
    assert got == [("a.md", "lib-a", 1, 3, "`lib-a`"), ("a.md", "lib-b", 2, 17, "`lib-b`"), ("b.md", "lib-c", 1, 0, "`lib-c`")]


def test_brackets_deep_many_and_unclosed(spark):
    rows = [("(a, f(b, [c, d]), {e, (g)})x)",), ("((((((1))))))z",), ("(" + "(1)," * 200 + "2), 3)",), ("(a, (b)",), ("()",), ("(é\U0001f600, 1)",)]
    df = spark.createDataFrame(rows, "t string").select(enclosed(F.col("t"), "(", ")").alias("inner"), top_level_parts(enclosed(F.col("t"), "(", ")"), "([{", ")]}").alias("parts"))
    got = [(r.inner, r.parts) for r in df.collect()]
    assert got == [("a, f(b, [c, d]), {e, (g)}", ["a", "f(b, [c, d])", "{e, (g)}"]), ("(((((1)))))", ["(((((1)))))"]), ("(1)," * 200 + "2", ["(1)"] * 200 + ["2"]), (None, None), ("", []), ("é\U0001f600, 1", ["é\U0001f600", "1"])]


def test_texts_are_composed_and_searched_once(spark):
    from weftline.plans import registry

    for name in ("validate_file_paths", "validate_symbols"):
        files = registry.QUERIES[name](spark, DIR).inputFiles()
        assert files and not [f for f in files if f.endswith(("part.parquet", "supplier.parquet"))]
