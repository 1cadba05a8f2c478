"""N-gram Jaccard self-join by rare-first prefix filtering.

Two documents link when the Jaccard similarity of their sets of distinct word
shingles is at least num / den.  Sets are ordered rare first; a pair at the
threshold shares one of the first n - ceil(t n) + 1 shingles of the longer and
of the first n - ceil(2t / (1+t) n) + 1 of the shorter set.  Pairs that meet
on such a shingle pass the length, positional and suffix filters and are
verified once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table, whole_texts, written
from .components import components
from .shingles import Words, shingle_sets

WIDTH = 5
NUM, DEN = 4, 5
#: Counters that stand for the shingles' document frequencies; only the order of the shingles, not the result, hangs on them.
SKETCH = 1 << 18
CHUNKS = 64
#: Bits of the filter that tells which sets are candidates; false positives only cost time.
FILTER_BITS = 1 << 25
SUFFIX_BINS = 32
CELL = 20_000
BATCH = 512


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def _sets(batches, width: int):
    """(batch of ids, list of sets) in small steps, so that long texts don't pile up."""
    words = Words()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(0, batch.num_rows, BATCH):
            yield ids.slice(i, BATCH), shingle_sets(words, texts.slice(i, BATCH).to_pylist(), width)


def _print(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set: two sums of its hashed members."""
    with np.errstate(over="ignore"):
        x = (s ^ (s >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        a, b = s.sum(dtype=np.uint64), (x ^ (x >> np.uint64(32))).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _digest(texts: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, n, f1, f2) of documents, and rows (chunk, counts) of the frequency sketch."""
    schema = "doc_id long, n long, f1 long, f2 long, chunk int, counts binary"

    def run(batches):
        counts, names = np.zeros(SKETCH, np.int64), ["doc_id", "n", "f1", "f2", "chunk", "counts"]
        for ids, sets in _sets(batches, width):
            prints = [_print(s) for s in sets]
            if sets:
                counts += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            m = len(sets)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if counts.any():
            parts = counts.reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(CHUNKS, pa.int64())] * 4, pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return texts.mapInArrow(run, schema)


def _sketch(digest: DataFrame) -> np.ndarray:
    """The summed counters, SKETCH in all; partial sums of 256 tables at a time."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t["counts"].to_pylist())
        return pa.table([pa.array([t["chunk"][0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])

    rows = digest.where("chunk is not null").select("chunk", "counts", F.spark_partition_id().alias("p"))
    rows = rows.groupBy("chunk", F.expr("p div 256")).applyInArrow(lambda t: add(t.select(["chunk", "counts"])), "chunk int, counts binary")
    out = np.zeros((CHUNKS, SKETCH // CHUNKS), np.int64)
    for r in rows.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def _prefixes(texts: DataFrame, order, width: int, num: int, den: int) -> DataFrame:
    """f1, f2, n, the prefix rare first and a histogram of the whole set."""
    schema = "f1 long, f2 long, n long, prefix array<long>, bins array<int>"

    def run(batches):
        rank = order.value
        seen: set[tuple[int, int]] = set()  # copies within a partition
        for _, sets in _sets(batches, width):
            out: list[tuple] = []
            for s in sets:
                n = len(s)
                if not n or (f := _print(s)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(f)
                p = n - -(-num * n // den) + 1
                slot = rank[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                first = np.lexsort((s, slot))[:p]
                bins = np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=SUFFIX_BINS)
                out.append((*f, n, s[first].view(np.int64), bins.astype(np.int32)))
            if out:
                a, b, n, prefix, bins = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bins, pa.list_(pa.int32()))], names=["f1", "f2", "n", "prefix", "bins"])

    return texts.mapInArrow(run, schema)


def _filter_bits(prints: DataFrame) -> np.ndarray:
    """A bit set of fixed size that holds the fingerprints f1, whatever their number."""
    piece = FILTER_BITS // CHUNKS

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            x = np.asarray(b.column(0)).view(np.uint64)
            for shift in (0, 32):
                bits[((x >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        for k in range(CHUNKS):
            part = bits[k * piece : (k + 1) * piece]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())], names=["chunk", "counts"])

    def union(t: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t["counts"].to_pylist()])
        return pa.table([pa.array([t["chunk"][0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])

    rows = prints.select("f1").mapInArrow(run, "chunk int, counts binary").select("chunk", "counts", F.spark_partition_id().alias("p"))
    rows = rows.groupBy("chunk", F.expr("p div 256")).applyInArrow(lambda t: union(t.select(["chunk", "counts"])), "chunk int, counts binary")
    out = np.zeros((CHUNKS, piece // 8), np.uint8)
    for r in rows.groupBy("chunk").applyInArrow(union, "chunk int, counts binary").toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def _whole_texts(texts: DataFrame, bits, width: int) -> DataFrame:
    """f1, f2 and the text of every set that may be a candidate: a text is half as long as its set's hashes."""

    def run(batches):
        held, ones, words = bits.value, np.uint64(FILTER_BITS - 1), Words()
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                own, out = batch.column(1).slice(i, BATCH).to_pylist(), []
                for s, text in zip(shingle_sets(words, own, width), own):
                    if len(s):
                        f = _print(s)
                        x = np.int64(f[0]).view(np.uint64)
                        k = [int((x >> np.uint64(shift)) & ones) for shift in (0, 32)]
                        if all(held[i >> 3] >> (7 - (i & 7)) & 1 for i in k):
                            out.append((*f, text))
                if out:
                    a, b, kept = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kept, pa.binary())], names=["f1", "f2", "text"])

    return texts.mapInArrow(run, "f1 long, f2 long, text binary")


def _verify(num: int, den: int, width: int):
    def cell(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        own, good, words = {}, [], Words()
        for i in range(0, sets.num_rows, BATCH):
            part = sets.slice(i, BATCH)
            own.update(zip(part["cid"].to_pylist(), shingle_sets(words, part["text"].to_pylist(), width)))
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            x, y = own[a], own[b]
            both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            if den * both >= num * (len(x) + len(y) - both):
                good.append((a, b))
        return pa.table([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], names=["a", "b"])

    return cell


def similar_classes(docs: DataFrame, *, width: int = WIDTH, num: int = NUM, den: int = DEN, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digest, classes, links): documents, classes of equal sets, and all links between classes.

    digest: doc_id, n, f1, f2 of every document; classes: cid, f1, f2, n, rep
    (smallest doc_id), members; links: a, b by cid.  Classes without shingles
    are left out.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    texts = _texts(docs, doc_id, text)
    both = written(_digest(texts, width), "digest")
    digest = both.where("chunk is null").select("doc_id", "n", "f1", "f2")
    order = spark.sparkContext.broadcast(_sketch(both))  # SKETCH numbers
    kept = _prefixes(texts, order, width, num, den).groupBy("f1", "f2", "n").agg(F.first("prefix").alias("prefix"), F.first("bins").alias("bins"))
    sized = digest.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))
    index = written(kept.withColumn("cid", F.monotonically_increasing_id()), "prefix")
    classes = sized.join(index.select("f1", "f2", "n", "cid"), ["f1", "f2", "n"])
    entry = index.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    # ceil(2 num n / (num + den)): what the shorter set must share with one at least as long
    short = entry.where(F.expr(f"pos < n - (2 * {num} * n + {num + den - 1}) div {num + den} + 1"))
    a, b = short.alias("a"), entry.alias("b")
    met = a.join(b, F.col("a.token") == F.col("b.token")).where(
        F.expr(
            f"(a.n < b.n or (a.n = b.n and a.cid < b.cid)) and {den} * a.n >= {num} * b.n"
            f" and 1 + least(a.n - a.pos, b.n - b.pos) - 1 >= ({num} * (a.n + b.n) + {num + den - 1}) div {num + den}"
        )
    )
    pairs = met.select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b")).distinct()
    # suffix filter: bins of the hash space bound the distance of the two sets from below
    bins = index.select("cid", "n", "bins")
    pairs = pairs.join(bins.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("bins").alias("xa")), "a").join(bins.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("xb")), "b")
    apart = F.aggregate(F.zip_with("xa", "xb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    pairs = written(pairs.where(F.expr(f"na + nb - 2 * (({num} * (na + nb) + {num + den - 1}) div {num + den})") >= apart).select("a", "b"), "pairs")
    # verification cells: pairs that share their smallest partner, split where there are many
    ends = pairs.select(F.col("a").alias("x"), F.least("a", "b").alias("m")).union(pairs.select(F.col("b").alias("x"), F.least("a", "b").alias("m")))
    home = ends.groupBy("x").agg(F.min("m").alias("home"))
    placed = pairs.join(home.withColumnRenamed("x", "a"), "a")
    room = placed.groupBy("home").agg(F.ceil(F.sqrt(F.count("*") / CELL)).cast("int").alias("c"))
    placed = written(placed.join(room, "home").select("home", F.pmod(F.xxhash64("a"), "c").alias("ca"), F.pmod(F.xxhash64("b"), "c").alias("cb"), "a", "b"), "cells")
    used = placed.select(F.col("a").alias("cid")).union(placed.select(F.col("b").alias("cid"))).distinct()
    prints = used.join(index.select("cid", "f1", "f2"), "cid")
    bits = spark.sparkContext.broadcast(_filter_bits(prints))  # FILTER_BITS bits
    # the cells are brought to the texts, so that these are exchanged twice only: those of one set to one, then to the cells
    whole = _whole_texts(texts, bits, width).groupBy("f1", "f2").agg(F.first("text").alias("text"))
    wanted = placed.select("home", "ca", "cb", F.col("a").alias("cid")).union(placed.select("home", "ca", "cb", F.col("b").alias("cid"))).distinct().join(prints, "cid")
    sets = whole.join(wanted, ["f1", "f2"]).select(F.col("home").alias("h"), F.col("ca").alias("i"), F.col("cb").alias("j"), "cid", "text")
    links = sets.groupBy("h", "i", "j").cogroup(placed.groupBy("home", "ca", "cb")).applyInArrow(_verify(num, den, width), "a long, b long")
    return digest, written(classes, "classes"), written(links, "links")


def similar(docs: DataFrame, *, width: int = WIDTH, num: int = NUM, den: int = DEN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id for every row of docs.

    n_similar counts the other rows linked directly, copies included;
    component_id is the smallest doc_id reachable by links.  Null and empty
    texts and those of white space have no shingles and no links.  Rows that
    repeat a doc_id count as documents of their own; a null doc_id is linked
    like others but gives no component_id unless a linked row has one.  Texts
    of any length count whole; a pair just at the threshold (a tie) is linked.
    Other columns are not read, whatever their names; an empty table gives no
    rows.
    """
    digest, classes, links = similar_classes(docs, width=width, num=num, den=den, doc_id=doc_id, text=text)
    size = classes.select("cid", "members")
    ways = links.select(F.col("a").alias("cid"), F.col("b").alias("other")).union(links.select(F.col("b").alias("cid"), F.col("a").alias("other")))
    degree = ways.join(size.select(F.col("cid").alias("other"), F.col("members").alias("k")), "other").groupBy("cid").agg(F.sum("k").alias("linked"))
    root = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "cid")
    least = classes.select("cid", "rep").join(root, "cid").groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = (
        classes.join(degree, "cid", "left").join(root.join(least, "root").select("cid", "component_id"), "cid", "left")
        .select("f1", "f2", "n", (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_similar"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    # A hot class is dealt out by the row, its one line repeated for each deal
    deals = 16
    rows = digest.withColumn("deal", F.when(F.col("n") > 0, F.pmod(F.xxhash64("doc_id"), F.lit(deals))).cast("int"))
    dealt = of_class.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    out = rows.join(dealt, ["f1", "f2", "n", "deal"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))
