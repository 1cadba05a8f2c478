"""Mixing sources to target weights by cube-method balanced sampling.

A source that is to give rho times its words takes every document floor(rho)
times, and once more with the inclusion probability that is left.  The flight
phase moves the probabilities of three documents at a time along the null
space of the two constraints, number of documents and number of words, until
one of them is 0 or 1; so both totals stay as they are.  A few of the smallest
documents of a block remain; the blocks' remainders fly again, and the last
dozen of a source land on the subset nearest to the totals.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, CAP = 1.5, 2.0
BLOCK = 4096
#: Documents of a block that may stay undecided: the landing tries all their subsets.
LAST = 12
#: Decided documents of a block, the largest, that stay on for the exchanges of the landing.
RESERVE = 32
EPS = 1e-9


def targets(sizes: list[int], *, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> list[float]:
    """Words of each source: shares of budget * all words by weight, none above cap times its own.

    What a capped source can't take is shared among the others by weight
    again, until none is above its cap; if all are capped, the rest is lost.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), budget * sum(sizes)
    while free:
        total = sum(w[i] for i in sorted(free))
        over = {i for i in free if left * w[i] / total >= cap * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in sorted(over):
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in sorted(over))
        free -= over
    return out


def flight(p: list[float], size: list[int], rng: random.Random, last: int = 2) -> list[float]:
    """Probabilities after the flight: all 0 or 1 but for at most `last` of the final ones, last >= 2.

    u = (s2 - s3, s3 - s1, s1 - s2) is the null vector of the rows (1, 1, 1)
    and (s1, s2, s3); equal sizes leave a plane, where two documents trade.
    """
    p = list(p)
    live: list[int] = []
    open_ = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    for at, i in enumerate(open_):
        live.append(i)
        while len(live) >= 3 and len(live) + len(open_) - at - 1 > last:
            a, b, c = live[-3:]
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = min(((1 - p[k]) if x > 0 else p[k]) / abs(x) for k, x in zip((a, b, c), u) if x)
            down = min((p[k] if x > 0 else (1 - p[k])) / abs(x) for k, x in zip((a, b, c), u) if x)
            step = up if rng.random() * (up + down) < down else -down
            for k, x in zip((a, b, c), u):
                p[k] += step * x
                if p[k] < EPS or p[k] > 1 - EPS:
                    p[k] = float(round(p[k]))
            live = [k for k in live if 0 < p[k] < 1]
    return p


def landing(p: list[float], size: list[int]) -> list[float]:
    """The last few: the subset whose words come nearest to the expected, then whose number does."""
    live = [i for i, x in enumerate(p) if 0 < x < 1]
    want, number = sum(p[i] * size[i] for i in live), sum(p[i] for i in live)
    subsets = np.arange(1 << len(live))
    words, count = np.zeros(len(subsets)), np.zeros(len(subsets))
    for k, i in enumerate(live):
        words += (subsets >> k & 1) * size[i]
        count += subsets >> k & 1
    best = int(np.lexsort((subsets, np.abs(count - number), np.abs(words - want)))[0])
    out = list(p)
    for k, i in enumerate(live):
        out[i] = float(best >> k & 1)
    return out


def settle(p: list[float], size: list[int], want: float, rounds: int = 64) -> list[float]:
    """Landed documents with up to `rounds` exchanges, each of one taken for one that isn't, or of one alone.

    A large document is decided last, where the small ones left can't make up
    for it; so the exchange that brings the words nearest to `want` is made.
    """
    x, s = np.array(p), np.array(size, dtype=np.int64)
    for _ in range(rounds):
        err = float((x * s).sum() - want)
        out = np.append(np.flatnonzero(x == 1), -1)
        into = np.append(np.flatnonzero(x == 0), -1)
        a, b = np.where(out < 0, 0, s[out]), np.where(into < 0, 0, s[into])
        order = np.argsort(b, kind="stable")
        at = np.searchsorted(b[order], a - err)
        best = (abs(err) - 0.5, -1, -1)
        for near in (np.clip(at - 1, 0, len(b) - 1), np.clip(at, 0, len(b) - 1)):
            left = np.abs(err - a + b[order][near])
            k = int(left.argmin())
            if left[k] < best[0]:
                best = (float(left[k]), int(out[k]), int(into[order[near[k]]]))
        if best[1:] == (-1, -1):
            break
        if best[1] >= 0:
            x[best[1]] = 0
        if best[2] >= 0:
            x[best[2]] = 1
    return x.tolist()


def _fly(land: bool):
    def block(t: pa.Table) -> pa.Table:
        # the smallest documents come last: they are what stays undecided
        t = t.sort_by([("size", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("key", "ascending")])
        p, size = t["p"].to_pylist(), t["size"].to_pylist()
        seed = f"{t['source'][0].as_py()}|{t['block'][0].as_py()}|{len(p)}"
        if any(0 < x < 1 for x in p):
            want = sum(x * s for x, s in zip(p, size))
            p = flight(p, size, random.Random(seed), LAST)
            if land or t["blocks"][0].as_py() == 1:
                p = settle(landing(p, size), size, want)
        done = land or t["blocks"][0].as_py() == 1 or not any(0 < x < 1 for x in t["p"].to_pylist())
        keep = [not done and (i < RESERVE or 0 < x < 1) for i, x in enumerate(p)]  # largest first
        return t.set_column(t.column_names.index("p"), "p", pa.array(p, pa.float64())).set_column(t.column_names.index("keep"), "keep", pa.array(keep, pa.bool_()))

    return block


def mix(docs: DataFrame, *, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, block: int = BLOCK, key: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: how often the mix takes each row.

    Sources are ordered by code point, null last, and weigh by their place.
    Blocks of about `block` rows are dealt by hash within a source, so a hot
    source is many blocks.  Each source's words differ from its target by the
    few documents that land; copies is at most ceil(cap).  Null and empty
    texts have size 0 and are taken by their probability like others; null
    doc_ids and repeated rows are rows of their own; other columns are not
    read; an empty table gives no rows.  key names a long column that tells
    rows of one id apart, returned beside the others.  Reruns agree: chance is seeded by
    source and block, and rows are ordered by id and size.
    """
    schema = "source int, doc_id long, size long, row long, key long, p double, base long, blocks long, block long, keep boolean"
    digest = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("name"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("row"), (F.col(key) if key else F.lit(None)).cast("long").alias("key")), "mixing")
    # one row a source: the catalogue of sources, not the data
    totals = digest.groupBy("name").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r["name"] is None, (r["name"] or "").encode()))
    want = targets([r["source_size"] for r in totals], weights=weights, budget=budget, cap=cap)
    spark = docs.sparkSession
    plan = []
    for i, (r, t) in enumerate(zip(totals, want)):
        rho = min(cap, t / r["source_size"]) if r["source_size"] else 0.0
        base = int(np.floor(rho + EPS))
        plan.append((i, r["name"], r["source_size"], t, base, rho - base if rho - base > EPS else 0.0, -(-r["n"] // block)))
    sources = spark.createDataFrame(plan, "source int, name string, source_size long, target double, base long, p double, blocks long")
    placed = digest.join(F.broadcast(sources) if len(plan) <= 10_000 else sources, digest["name"].eqNullSafe(sources["name"]))
    rows = placed.select("source", "doc_id", "size", "row", "key", "p", "base", "blocks", F.pmod(F.xxhash64("doc_id", "row"), F.col("blocks")).alias("block"), F.lit(False).alias("keep"))
    flown = written(rows.groupBy("source", "block").applyInArrow(_fly(False), schema), "flight")
    decided = [flown.where("not keep")]
    rest = flown.where("keep")
    most = max([x[-1] for x in plan], default=1)  # blocks of the largest source; each leaves LAST + RESERVE rows at most
    while most > 1:  # two blocks become one, as these are few against block
        most = -(-(LAST + RESERVE) * most // block)
        rest = written(rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.lit(most))).groupBy("source", "block").applyInArrow(_fly(False), schema), "flight")
        decided.append(rest.where("not keep"))
        rest = rest.where("keep")
    decided.append(rest.withColumn("block", F.lit(0).cast("long")).groupBy("source", "block").applyInArrow(_fly(True), schema))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    out = out.withColumn("copies", F.col("base") + F.col("p").cast("long"))
    facts = sources.select("source", "source_size", "target")
    return out.join(F.broadcast(facts) if len(plan) <= 10_000 else facts, "source").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", *([F.col("key").alias(key)] if key else []))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
