import pytest
from pyspark.sql import functions as F

from weftline.functions import paths, similarity, text
from weftline.operators.lookup import nearest_entries, nearest_names


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_occurrences_know_their_places(spark):
    df = spark.createDataFrame([("a1\nb22 c3\n\nd4",), ("none",), (None,), ("",)], "t string")
    rows = text.occurrences(df, "t", r"([a-z])(\d+)", {"letter": 1, "digits": 2}).orderBy("ord").collect()
    assert [(r.raw, r.line, r.start, r.letter, r.digits) for r in rows] == [("a1", 1, 0, "a", "1"), ("b22", 2, 3, "b", "22"), ("c3", 2, 7, "c", "3"), ("d4", 4, 11, "d", "4")]


def test_brackets(spark):
    assert column(spark, ["(a(b)c)d", "(open", "()"], lambda c: text.enclosed(c, "(", ")")) == ["a(b)c", None, ""]
    assert column(spark, ["a, f(b, c), [d, e], {g,h}", "x,", ""], lambda c: text.top_level_parts(c, "([{", ")]}")) == [["a", "f(b, c)", "[d, e]", "{g,h}"], ["x"], []]
    assert column(spark, ["a: 1,\nb: {\n c: 2\n},\nd"], text.lines_at_depth_zero) == [["a: 1,", "b: {", "d"]]


def test_paths(spark):
    assert column(spark, ["/a/./b/../c/", "/..", "/a//b"], paths.normalized) == ["/a/c", "/", "/a/b"]
    inside = column(spark, ["/project", "/project/src/x.ts", "/other/place", "/projectExtra/x", "/project/../other"], lambda c: paths.within_root(paths.normalized(c), "/project"))
    assert inside == [True, True, False, False, False]
    shown = ["YourProject/file.ts", "my-project/x.ts", "Example.tsx", "foo", "src/<component>/f.ts", "first.ts", "package.json", "src/utils/a.ts"]
    assert column(spark, shown, paths.example_path) == [True] * 6 + [False, False]
    assert column(spark, ["GET", "ab", "Modal", "testing", "createUser"], paths.example_symbol) == [True, True, True, True, False]
    assert column(spark, ["docs/a/b.md", "README.md", "docs/x.txt", "node_modules/docs/a.md"], lambda c: paths.included(c, ["docs/**/*.md", "README.md"], ["**/node_modules/**"])) == [True, True, False, False]


def test_similarity(spark):
    pairs = [("", "", 0), ("abc", "", 3), ("kitten", "sitting", 3), ("abc", "abd", 1)]
    rows = spark.createDataFrame(pairs, "a string, b string, d int").select(F.levenshtein("a", "b").alias("x"), "d", similarity.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.x == r.d for r in rows) and rows[0].r == 1.0
    assert column(spark, ["18 <20", "3.x", "any", "workspace:*", "v16"], similarity.major) == [18, 3, None, None, 16]
    assert column(spark, ["stories", "boxes", "glass", "hooks", "buses"], similarity.singular) == ["story", "boxe", "glass", "hook", "buse"]
    assert column(spark, [0.5, 1.49, 2.5], similarity.half_up, "double") == [1, 1, 3]


@pytest.mark.parametrize("target, names, match", [("README", ["readme", "other"], "readme"), ("fle", ["file", "folder", "xyz"], "file"), ("abc", ["xyzxyz", "mnopqr"], None), ("a", ["b", "bcde"], "b"), ("Same", ["same", "Same"], "same"), ("createUsr", ["creatUser", "createUser", "x"], "createUser")])
def test_nearest_names(spark, target, names, match):
    given = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "candidate string, ord int")
    rows = nearest_names(spark.createDataFrame([(target,)], "target string"), given).collect()
    assert [r.match for r in rows] == ([match] if match else [])


def test_nearest_names_is_the_nested_loop(spark):
    import random

    rng = random.Random(5)
    names = ["".join(rng.choice("abcAB") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    targets = ["".join(rng.choice("abcAB") for _ in range(rng.randint(0, 9))) for _ in range(60)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    expected = {}
    for t in set(targets):
        best = min(((0 if t.lower() == c.lower() and t != c else 1, distance(t.lower(), c.lower()), i) for i, c in enumerate(names) if distance(t.lower(), c.lower()) <= 3), default=None)
        if best:
            expected[t] = names[best[2]]
    given = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "candidate string, ord int")
    got = {r.target: r.match for r in nearest_names(spark.createDataFrame([(t,) for t in targets], "target string"), given).collect()}
    assert got == expected


def test_nearest_names_of_any_length(spark):
    """Names of up to 45 characters that share long beginnings, mutated by up to four edits, within two groups."""
    import random

    rng = random.Random(9)

    def mutated(name):
        for _ in range(rng.randint(0, 4)):
            i, kind = rng.randint(0, len(name)), rng.randint(0, 2)
            name = name[:i] + (rng.choice("xyz") if kind else "") + name[i + (kind != 1) :]
        return name

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    names = list({"test_should_"[: rng.randint(0, 12)] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 33))) for _ in range(60)})
    targets = list({mutated(rng.choice(names)) for _ in range(60)})
    expected = {}
    for t in targets:
        for g in "pq":
            near = [(0 if t.lower() == c.lower() and t != c else 1, distance(t.lower(), c.lower()), i, c) for i, c in enumerate(names) if "pq"[i % 2] == g]
            if best := min((n for n in near if n[1] <= 3), default=None):
                expected[t, g] = best[3]
    given = spark.createDataFrame([(n, i, "pq"[i % 2]) for i, n in enumerate(names)], "candidate string, ord int, g string")
    asked = spark.createDataFrame([(t, g) for t in targets for g in ["p", "q", None]], "target string, g string")
    assert {(r.target, r.g): r.match for r in nearest_names(asked, given, within=["g"]).collect()} == expected


def test_nearest_entries(spark):
    entries = spark.createDataFrame([("helpers.ts", "src", 0), ("Helper.ts", "src", 1), ("zzz", "src", 2), ("helper.ts", "lib", 3)], "entry string, parent string, ord int")
    targets = spark.createDataFrame([("helper.ts", "src"), ("helper.js", "src"), ("qqq", "src")], "target string, parent string")
    assert {r.target: r.match for r in nearest_entries(targets, entries).collect()} == {"helper.ts": "Helper.ts", "helper.js": "Helper.ts"}
