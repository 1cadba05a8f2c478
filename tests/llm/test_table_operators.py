"""Sharding, nearest neighbours, mixing, pages, URLs, the pipeline."""

import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brute import brute_join
from weftline.llm import ann, html_extract, html_pages, mixing, queries, sharding, url_filter

DOCS = "doc_id long, text string, source string"
DIR = "/root/testdata/sf0.001"


def frame(spark, schema, rows):
    return spark.createDataFrame(list(rows), schema)


# sharding


def check_shards(rows, got, shards=8):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t, _ in rows if i is not None)
    for s in range(shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    return [sizes[s] for s in range(shards)]


def test_sharding(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 400))), "s") for i in range(900)]
    rows += [(1000 + i, "the same text of a large group of copies " * 3, "s") for i in range(500)] + [(7, None, "s"), (None, "x", "s"), (None, None, "s"), (3, rows[3][1], "s")]
    got = sharding.shard_by_bytes(frame(spark, DOCS, rows)).collect()
    sizes = check_shards(rows, got)
    assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 8 + 2 * 801
    shards = {}
    for r in got:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(v) > 1 for v in shards.values()) <= 8  # only groups at a boundary
    again = sharding.shard_by_bytes(frame(spark, DOCS, rows)).collect()
    assert Counter((r.doc_id, r.shard) for r in again if r.doc_id != 3) == Counter((r.doc_id, r.shard) for r in got if r.doc_id != 3)


def test_shards_are_runs_of_the_sorted_keys(spark):
    """Brute force: rows sorted by (hash of the text, doc_id) fall into the shards in order, and slots count them."""
    rng = random.Random(8)
    rows = [(i, None if i % 50 == 0 else "".join(rng.choice("abc ") for _ in range(rng.randint(0, 300))), "s") for i in range(700)] + [(900 + i, "one hot text", "s") for i in range(300)]
    got = {r.doc_id: r for r in sharding.shard_by_bytes(frame(spark, DOCS, rows), 8).collect()}
    order = sorted(rows, key=lambda r: ((42 if r[1] is None else xxhash.xxh64_intdigest(r[1].encode(), 42)) >> 1, r[0]))
    places = [(got[r[0]].shard, got[r[0]].slot) for r in order]
    assert places == sorted(places)
    ends, total, below = [], sum(r.size for r in got.values()), 0
    for a, b in zip(order, order[1:]):
        below += got[a[0]].size
        if got[a[0]].shard != got[b[0]].shard:
            ends += [below] * (got[b[0]].shard - got[a[0]].shard)
    assert len(ends) == 7 and all(abs(e - total * (i + 1) / 8) <= 0.01 * total / 8 + 301 for i, e in enumerate(ends))


def test_sharding_of_odd_tables(spark):
    assert sharding.shard_by_bytes(frame(spark, DOCS, [])).count() == 0
    one = [(1, "a", "s")] * 100  # rows that nothing tells apart are cut as well
    sizes = check_shards(one, sharding.shard_by_bytes(frame(spark, DOCS, one)).collect())
    assert max(sizes) - min(sizes) <= 4
    check_shards(one[:3], sharding.shard_by_bytes(frame(spark, DOCS, one[:3])).collect())


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 9), "s") for i in range(200)]
    sharding.write_shards(frame(spark, DOCS, rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.doc_id for r in back) == list(range(200)) and {r.shard for r in back} == {0, 1, 2, 3}


def test_written_shards_follow_every_level(spark, tmp_path):
    """Equal rows are told apart by their place alone, and are cut on disk as in the listing."""
    same = frame(spark, "doc_id long, text string, shard string, h int", [(1, "a", "own", 5)] * 100).repartition(3)
    same.write.parquet(str(tmp_path / "in"))
    same = spark.read.parquet(str(tmp_path / "in"))
    listed = Counter(r.shard for r in sharding.shard_by_bytes(same, 4).collect())
    sharding.write_shards(same, str(tmp_path / "same"), 4)
    back = spark.read.parquet(str(tmp_path / "same")).collect()
    assert listed == {i: 25 for i in range(4)} and Counter(r.shard for r in back) == listed and {r.h for r in back} == {5}



# nearest neighbours


def exact(rows, queries_, k=5):
    out = {}
    for q, v in queries_:
        v = np.array(v)
        near = sorted((-(np.array(x) * v).sum() / (np.sqrt((np.array(x) ** 2).sum()) * np.sqrt((v * v).sum())), i) for i, x in rows if i != q)
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_ann_recall_scores_and_ties(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(np.float32(x)) for x in rng.standard_normal(16)]) for i in range(3000)]
    copies = [(5000 + i, vectors[10][1]) for i in range(40)]
    bad = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [1.0]), (9006, [float("inf")] * 16), (None, [1.0] * 16)]
    df = frame(spark, "vec_id long, embedding array<float>, score string", [(i, v, "x") for i, v in vectors + copies + bad])
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), row_block=1000).collect()
    truth = exact(vectors + copies, [(i, v) for i, v in vectors + copies if i % 50 == 0])
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by.keys() == truth.keys() and all(len(v) == 5 for v in by.values())
    hits = sum(len({i for i, _ in by[q]} & {i for i, _ in truth[q]}) for q in truth)
    assert hits / (5 * len(truth)) >= 0.9
    scores = dict(vectors + copies)
    for q, v in by.items():
        for i, s in v:
            a, b = np.array(scores[q]), np.array(scores[i])
            assert abs(s - (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))) < 1e-12
        assert v == sorted(v, key=lambda x: (-x[1], x[0]))


def test_forest_visits_a_falling_share():
    """Of vectors of random directions the forest finds 0.9 of the nearest in a part of the rows that falls with their number; near clusters take less."""
    rng, shares = np.random.default_rng(3), []
    for n in (2000, 12_000):
        x = rng.standard_normal((n, 64))
        asked = rng.choice(n, 64, replace=False)
        near = x / np.linalg.norm(x, axis=1)[:, None]
        cos = near[asked] @ near.T
        cos[np.arange(64), asked] = -2
        top = np.argsort(-cos, axis=1)[:, :5]
        (_, mark), = ann.candidates(x, x[asked])
        assert np.take_along_axis(mark, top, axis=1).mean() >= 0.9
        shares.append(mark.mean())
    assert shares[1] < shares[0] < 0.5 and shares[1] < 0.35


def test_ann_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    empty = frame(spark, schema, [])
    assert ann.nearest(empty, empty).count() == 0
    few = frame(spark, schema, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])])
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]


# mixing


def test_targets():
    got = mixing.targets([100, 100, 100, 1000])
    assert sum(got) == pytest.approx(1.5 * 1300) and got[0] == 200 and got[1] == 200 and all(t <= 2 * s + 1e-9 for t, s in zip(got, [100, 100, 100, 1000]))
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_flight_keeps_the_totals():
    rng = random.Random(4)
    for last in (2, 12):
        size = [rng.randint(0, 50) for _ in range(300)]
        p = [0.37] * 300
        q = mixing.flight(p, size, random.Random(1), last)
        assert sum(0 < x < 1 for x in q) <= last and all(0 <= x <= 1 for x in q)
        assert sum(q) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(q, size)) == pytest.approx(0.37 * sum(size))
    share = np.mean([mixing.flight([0.25] * 40, list(range(40)), random.Random(s)) for s in range(400)], axis=0)
    assert abs(share - 0.25).max() < 0.12  # every document keeps its probability


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(1, 90))), f"src{i % 3}" if i % 7 else "hot") for i in range(1500)]
    rows += [(2000, "w " * 4000, "src1"), (2001, None, "src1"), (2002, "", None), (2003, "x y z", None), (None, "a b", "src2"), (5, "again w", "src2"), (5, "again w", "src2")]
    df = frame(spark, DOCS + ", size string", [(*r, "old") for r in rows])
    got = mixing.mix(df, block=200).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r.size for r in got) == sorted(count(t) for _, t, _ in rows)
    per = {}
    for r in got:
        assert r.taken <= 2 * r.size and r.taken == r.size * r.copies
        per.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    own = Counter()
    for _, t, s in rows:
        own[s] += count(t)
    names = sorted((s for s in own if s is not None), key=str.encode) + [None]
    want = mixing.targets([own[s] for s in names])
    assert {k for k in per} == {(own[s], round(t, 6)) for s, t in zip(names, want)}
    for (source, target), taken in per.items():
        assert abs(sum(taken) - target) <= max(5, 0.02 * target)
    again = mixing.mix(df.repartition(3), block=200).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_mix_of_an_empty_table(spark):
    assert mixing.mix(frame(spark, DOCS, [])).count() == 0


# pages


def test_marginals_are_those_of_all_assignments():
    import itertools

    rng = random.Random(1)
    for _ in range(20):
        n = rng.randint(2, 7)
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        kind = [rng.randrange(3) for _ in range(n)]
        local = [rng.uniform(-2, 2) for _ in range(n)]
        edge = [[[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)] for _ in range(3)]
        mass = np.zeros((n, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(local[i] for i in range(n) if y[i]) + sum(edge[kind[i]][y[parent[i]]][y[i]] for i in range(1, n)))
            for i in range(n):
                mass[i, y[i]] += w
        assert np.allclose(html_extract.marginals(local, parent, kind, edge)[0], np.log(mass[:, 1] / mass[:, 0]))


def test_held_out_pages():
    fitted, wrong, total = html_extract.model(), 0, 0
    for seed in range(5000, 5100):
        source, labels = html_pages.page(seed)
        odds = html_extract.content_odds(html_extract.parse(source)[0], *fitted)
        assert len(odds) == len(labels) + 1
        wrong += sum((o > 0) != y for o, y in zip(odds[1:], labels))
        total += len(labels)
    assert wrong / total < 0.05


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p><p>no";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href=/b>About</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Caf&eacute; &amp; bar</h1><p>First &lt;b&gt;  block<br>goes <b>on<p>Second&nbsp;block, unclosed<!-- <p>hidden</p> -->
<ul><li>One point<li>Two points</ul><div class="ad">Buy now</div><blockquote>Quoted &#8364;5</blockquote>
<section id="comments"><p>Nice post!</p></section></article><form><p>Join our list</p><input></form><footer><p>&copy; me</p></footer></body></html>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "u", "plain &amp; text"), (4, "u", "<p>open <b>tags"), (5, "u", "<<<>>> <a href='x"), (6, "u", "<article>" + "<p>word </p>" * 20_000 + "</article>"), (6, "u", "<div>" * 3000 + "deep")]
    got = html_extract.extract(frame(spark, "page_id long, url string, html string, text string", [(*r, "x") for r in rows])).collect()
    texts = [r.text for r in got]
    assert texts[0] == "Café & bar\nFirst <b> block goes on\nSecond block, unclosed\nOne point\nTwo points\nQuoted €5"
    assert texts[1] == texts[2] == "" and texts[3] == "plain & text" and texts[4] == "open tags" and texts[6].count("\n") == 19_999
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows)


def test_text_in_the_body_itself(spark):
    """Loose text is kept where it reads like an article, beside blocks or not; rows of links aren't."""
    loose = "<body>An article that stands in the body, with <b>no block</b> around it.<br>It goes on.<div class=footer>Copyright</div></body>"
    links = '<body><a href=x>Home</a> | <a href=y>About us</a><hr><div class="content"><p>One paragraph of text that is long enough.</p></div></body>'
    rows = [(1, "u", loose), (2, "u", links)]
    got = {r.page_id: r.text for r in html_extract.extract(frame(spark, "page_id long, url string, html string", rows)).collect()}
    assert got == {1: "An article that stands in the body, with no block around it. It goes on.", 2: "One paragraph of text that is long enough."}
    assert html_extract.extract(frame(spark, "page_id long, url string, html string", [])).count() == 0


@pytest.mark.parametrize("source", ["<div>" * 40_000 + "x</p>" * 40_000, "<b>" * 40_000 + "</i>x" * 40_000, "<li><ul>" + "<div>" * 20_000 + "<li>a</li>" * 20_000, "<table><tr>" + "<td>a" * 40_000])
def test_deep_pages_take_time_in_proportion(source):
    start = time.time()
    html_extract.parse(source)
    assert time.time() - start < 5


# URLs


@pytest.mark.parametrize("glob", ["*", "a*", "*a", "a?c", "*a*b*", "ab", "?", "", "*.b/*", "é*", "a" * 70 + "*b"])
def test_automaton_is_the_regex(spark, glob):
    rng = random.Random(glob)
    texts = ["".join(rng.choice("abc./é") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["a" * 70 + "xxb", "a" * 69 + "b", ""]
    a = url_filter.compile_globs(["zz*", glob, "*q"])
    df = frame(spark, "t string", [(t,) for t in texts])
    got = [r[0] for r in df.select(url_filter.accepted(url_filter.run_automaton(a, df.t), a.accept[1])).collect()]
    pattern = re.compile("".join(".*" if c == "*" else "[\\s\\S]" if c == "?" else re.escape(c) for c in glob), re.S)
    plain = lambda t: bool(pattern.fullmatch(t)) if glob.isascii() else None
    for t, g in zip(texts, got):
        if plain(t) is not None:
            assert g == plain(t), (glob, t)


def test_judgements(spark):
    urls = ["http://EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "https://a.www.example.com/en/x", "http://b.example.com/en/", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/de/", "http://x.net/fr", "http://x.org?com/", "http://spam.org/", "http://x.com", "no url", None, "://net/fr/", "http://example.com.org/en/", "http://x.org/com/", "HTTP://A.NET/es/#", "http://é.com/ü"]
    got = url_filter.judge(frame(spark, "page_id long, url string, rule int", [(i, u, 1) for i, u in enumerate(urls)])).orderBy("page_id").collect()
    want = ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, None, None, None, None, "net/fr/", None, None, "net/es/", "com/"]
    assert [r.rule for r in got] == want
    assert [r.verdict for r in got] == ["block", "allow", "allow", "block", "allow", "block", "allow", "allow", "allow", "block", "allow", "allow", "allow", "block", "allow", "allow", "block", "allow"]
    assert (got[0].host, got[0].path) == ("example.com", "/en/x") and (got[8].host, got[8].path) == ("x.org", "") and (got[12].host, got[12].path) == ("", "") and got[10].path == ""


# queries and pipeline


def test_canonical_urls(spark):
    """Case, escapes and dot segments don't hide a blocked word; host and path stay as the url has them."""
    urls = ["http://a.org/CASINO/x", "http://a.org/%63asino/", "http://a.org/ad/../ads/x", "http://a.org/a/./%61ds/%2e%2e/ads/y", "http://a.org/c/../x", "http://a.org/%2Fads%2F", "http://a.org/100%", "http://A.org", "http://a.org/..", "no url", None, "http://x.net/es/casino", "http://a.org/é%C3%A9%zz"]
    pages = frame(spark, "page_id long, url string, host string, rule int", [(i, u, "own", 1) for i, u in enumerate(urls)])
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert [got[i].verdict for i in range(len(urls))] == ["block"] * 4 + ["allow"] * 7 + ["block", "allow"]
    assert (got[1].host, got[1].path) == ("a.org", "/%63asino/") and got[7].host == "a.org" and got[11].rule == "net/es/"
    forms = pages.select(url_filter.canonical(*url_filter.host_and_path(pages.url))).collect()
    assert [r[0] for r in forms[:9]] == ["a.org/casino/x", "a.org/casino/", "a.org/ads/x", "a.org/a/ads/y", "a.org/x", "a.org/%2fads%2f", "a.org/100%", "a.org", "a.org"]
    c = duckdb.connect()
    c.register("pages", pages.select("page_id", "url").toPandas().astype({"url": object}))
    assert {r[0]: r[1:] for r in c.sql(queries.SQL["op10_url_filter"]).fetchall()} == {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_globs_as_a_table(spark):
    """Some hundred globs, more than the masks that are written out, hold what fnmatch holds."""
    rng = random.Random(4)
    globs = ["*" + "".join(rng.choice("abcd") for _ in range(6)) + "*" for _ in range(150)] + [None]
    urls = [f"http://h.org/{''.join(rng.choice('abcd') for _ in range(60))}" for _ in range(60)] + [f"http://h.org/{g.strip('*')}" for g in globs[:20]]
    pages = frame(spark, "page_id long, url string", list(enumerate(urls)))
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, rules=(), blocked=frame(spark, "glob string", [(g,) for g in globs + globs])).collect()}
    assert got == {i: "block" if any(g.strip("*") in u for g in globs if g) else "allow" for i, u in enumerate(urls)}
    with pytest.raises(ValueError):
        url_filter.globs_of(frame(spark, "glob string", [("a" * 300_000,)]))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want, got = c.sql(queries.SQL[name]).df(), queries.QUERIES[name](spark, DIR).toPandas()
    cols = sorted(want.columns)
    rows = lambda df: sorted(tuple("~" if v is None or v != v else v for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))
    assert cols == sorted(got.columns) and rows(want) == rows(got)


def test_pipeline_repeated_ids(spark):
    import corpus_pipeline as p

    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(30))
    same, other, void, lone = text(), text(), text(), text()
    rows = [(1, same), (1, same), (4, same), (None, same), (2, other), (4, lone), (None, void), (None, void), (None, None), (None, "")]
    docs = frame(spark, "doc_id long, text string, source string", [(i, t, "s") for i, t in rows])
    got = Counter((r.doc_id, r.text) for r in p.drop_near_duplicates(spark, docs, DIR).collect())
    assert got == Counter([(1, same), (2, other), (4, lone), (None, void), (None, None), (None, "")])
    rows = [(None if i % 3 else i % 2, text(), "ab"[i % 2]) for i in range(400)]
    mixed = p.mix_sources(spark, frame(spark, "doc_id long, text string, source string", rows), DIR).collect()
    taken = Counter()
    for r in mixed:
        taken[r.source] += len(r.text.split())
    want = dict(zip("ab", mixing.targets([6000, 6000])))
    assert all(abs(taken[s] - want[s]) <= 30 for s in "ab") and max(Counter(r.text for r in mixed).values()) <= 2


def test_pipeline_exchanges_no_whole_rows(spark):
    """near_duplicates and mixing bring their decisions to the rows: no row with its text is exchanged, however large the decisions are."""
    import corpus_pipeline as p

    rng = random.Random(12)
    text = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(30))
    rows = [(i, text(), "ab"[i % 2]) for i in range(300)]
    rows += [(1000 + i, rows[i][1], "a") for i in range(0, 300, 7)] + [(2000, None, None), (None, "", "b")]
    docs = frame(spark, DOCS, rows).repartition(5)
    bound, threshold = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(bound, "-1")
    try:
        for stage, want in ((p.drop_near_duplicates, Counter(r for r in rows if not 1000 <= (r[0] or 0) < 2000)), (p.mix_sources, None)):
            out = stage(spark, docs, DIR)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Join" not in plan, plan
            got = Counter(map(tuple, out.collect()))
            assert got == Counter(map(tuple, out.collect()))
            assert got == want if want else set(got) <= set(rows) and max(got.values()) == 2
    finally:
        spark.conf.set(bound, threshold)


def test_numbers_of_keys(spark):
    """Each row gets its own number, 0 without one, from however many partitions and however they are cut again."""
    from weftline.llm import _common as c

    rows = c.keyed(spark.range(1000).repartition(7))
    key = {r["id"]: r["__key"] for r in rows.collect()}
    assert len({k >> c.ROW_BITS for k in key.values()}) == 7 and len(set(key.values())) == 1000
    facts = spark.createDataFrame([(k, i + 1) for i, k in key.items() if i % 3 == 0 and i > 500], "__key long, number long")
    number = c.numbers_of(facts, "test")
    want = {i: i + 1 if i % 3 == 0 and i > 500 else 0 for i in key}
    for cut in (rows, rows.repartition(3), rows.orderBy("id").coalesce(1)):
        assert {r["id"]: r.n for r in cut.select("id", number("__key").alias("n")).collect()} == want
    assert {r.n for r in rows.select(c.numbers_of(facts.limit(0), "test")("__key").alias("n")).collect()} == {0}


def test_pipeline_of_odd_tables(spark):
    """Columns named like those that stages make stay as they are; an empty table goes through all stages."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("grade", "rejected", "p_toxic", "copies", "component_id", "n_similar", "size", "shard", "hits")}
    wide = docs.withColumns(extra)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, wide, DIR)
        assert out.columns == wide.columns, name
        assert out.count() and all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in extra), name
        assert stage(spark, wide.limit(0), DIR).count() == 0, name
    assert p.STAGES[-1][1](spark, wide.limit(0), DIR).count() == 0 and p.STAGES[-1][1](spark, wide.limit(5), DIR).count() == 5


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen, texts = docs, {r.doc_id: r.text for r in docs.collect()}
    names, kept = [n for n, _ in p.STAGES], {}
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "sentencepiece"]
    for name, stage in p.STAGES:
        seen = p.written(stage(spark, seen, DIR), "test")
        kept[name] = seen.collect()
        if name != "sentencepiece":
            assert seen.columns == docs.columns
    bad = re.compile(r"\b(idiot|clown|pathetic|worthless|trash|scum|moron|disgusting|stupid|loser)\b", re.I)
    after = {r.doc_id for r in kept["toxicity"]}
    assert not any(bad.search(texts[i]) for i in after) and all(i in after for i, t in texts.items() if re.fullmatch(r"[a-z.,\s]{20,}", t.lower()) and not bad.search(t))
    groups = {r[0]: r[3] for r in brute_join([(r.doc_id, r.text, "s") for r in kept["toxicity"]])}
    assert {r.doc_id for r in kept["near_duplicates"]} == {i for i, c in groups.items() if i == c}
    assert {r.doc_id for r in kept["secrets"]} == {r.doc_id for r in kept["near_duplicates"]} and not any(re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r.text) for r in kept["secrets"])
    assert max(Counter(r.doc_id for r in kept["mixing"]).values()) <= 2 and len(kept["sentencepiece"]) == len(kept["mixing"])
    assert all(r.round_trip for r in kept["sentencepiece"])
