"""Nearest neighbours by a hash-prefix forest.

Every vector has one long hash string per tree: the signs of random
projections.  A tree is the sorted array of its strings.  A query descends to
its longest prefix match in each tree, then all trees ascend together, level
by level, until the rows sharing that many leading bits suffice; these are
compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table

TREES = 192
BITS = 30
#: The trees ascend until together they hold so many rows of a block of n (each tree counts): SHARE * n * (2000 / n) ** FALL.
#: The share falls with the block; both are set so that of vectors of random directions 0.9 of the nearest are found.
SHARE, FALL = 0.5, 0.25
ROW_BLOCK, QUERY_BLOCK = 32768, 16384
K = 5
SCHEMA = "query_id long, vec_id long, score double"


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def codes(x: np.ndarray, trees: int, bits: int, seed: int = 11) -> np.ndarray:
    """Hash strings as integers, first bit highest: an array of trees by rows."""
    planes = np.random.default_rng(seed).standard_normal((trees * bits, x.shape[1]))
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int32)
    out = np.empty((trees, len(x)), dtype=np.int32)
    for t in range(trees):
        out[t] = ((x @ planes[t * bits : (t + 1) * bits].T) > 0) @ weights
    return out


def needed(n: int, share: float = SHARE, fall: float = FALL) -> float:
    """How many rows of a block of n the trees of a query must hold together."""
    return share * n * (2000 / max(n, 1)) ** fall


def candidates(rows: np.ndarray, queries: np.ndarray, *, trees: int = TREES, bits: int = BITS, share: float = SHARE):
    """For portions of the queries: their places, and a mark for each query and row that some tree offers."""
    n, m = len(rows), len(queries)
    code, asked = codes(rows, trees, bits), codes(queries, trees, bits)
    order = np.argsort(code, axis=1, kind="stable").astype(np.int32)
    arrays = np.take_along_axis(code, order, axis=1)
    del code
    lo, hi = np.zeros((trees, m), dtype=np.int64), np.full((trees, m), n, dtype=np.int64)
    open_ = np.ones(m, dtype=bool)
    for level in range(bits, -1, -1):  # from the longest prefixes up, all trees at one level
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        shift = bits - level
        first = (asked[:, at].astype(np.int64) >> shift) << shift
        a = np.stack([np.searchsorted(arrays[t], first[t]) for t in range(trees)])
        b = np.stack([np.searchsorted(arrays[t], first[t] + (1 << shift)) for t in range(trees)])
        enough = (b - a).sum(axis=0) >= (needed(n, share) if level else 0)
        lo[:, at[enough]], hi[:, at[enough]] = a[:, enough], b[:, enough]
        open_[at[enough]] = False
    for q in range(0, m, 64):
        mark = np.zeros((min(64, m - q), n), dtype=bool)
        for t in range(trees):
            a, size = lo[t, q : q + 64], (hi - lo)[t, q : q + 64]
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) + np.repeat(a - ends + size, size)
            mark[np.repeat(np.arange(len(a)), size), order[t, place]] = True
        yield q, mark


def search_block(rows: np.ndarray, row_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, *, k: int = K, trees: int = TREES, bits: int = BITS, share: float = SHARE):
    """The k nearest found of each query among rows, by the forest over rows; ties to smaller ids."""
    norms = np.sqrt((rows * rows).sum(axis=1))
    out = []
    for first, marks in candidates(rows, queries, trees=trees, bits=bits, share=share):
        for q, mark in enumerate(marks, first):
            found = np.flatnonzero(mark & (row_ids != query_ids[q]))
            if len(found) < k:  # too few offered: all are asked
                found = np.flatnonzero(row_ids != query_ids[q])
            if not len(found):
                continue
            v = queries[q]
            size = np.sqrt((v * v).sum())
            near = (rows[found] @ v) / (norms[found] * size)
            if len(found) > k:
                found = found[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9]
            # row by row in one fixed order, so that equal vectors have equal scores wherever they lie
            exact = (rows[found] * v).sum(axis=1) / (norms[found] * size)
            best = np.lexsort((row_ids[found], -exact))[:k]
            out.append((np.full(len(best), query_ids[q]), row_ids[found][best], exact[best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([])]


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = K, trees: int = TREES, bits: int = BITS, share: float = SHARE, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by cosine.

    vectors and queries hold vec_id and embedding.  Rows are dealt into blocks
    of about row_block by hash, each block has its own forest, and each block
    of queries asks every one; per pair of blocks only k rows a query come
    back, and a window takes the best k.  Vectors that are null, zero, of
    another length than most, or hold null or non-finite components take no
    part.  Null ids take no part; a repeated id is several candidates, but is
    never a neighbour of itself; ties go to the smaller vec_id.  Copies of a
    vector are dealt to all blocks, so no block grows with them.  Other
    columns are not read, whatever their names; an empty table gives no rows.
    A query's work is a share of each block, so it grows with the rows, more
    slowly within a block (see needed).
    """
    value = F.transform("embedding", lambda v: v.cast("double"))
    sound = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('inf')) and exists(embedding, v -> v <> 0)"
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding"))
    asked = queries.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes[0]["d"], sizes[0]["n"]
    rows, asked = rows.where(F.size("embedding") == d), asked.where(F.size("embedding") == d)
    m = asked.count()
    row_blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-m // query_block))
    salt = F.xxhash64("vec_id", F.monotonically_increasing_id())  # copies and repeated ids spread as well
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.withColumn("rb", F.pmod(salt, F.lit(row_blocks)).cast("int")).withColumn("qb", every(query_blocks))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("rb", every(row_blocks))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            got = search_block(_vectors(a["embedding"]), np.asarray(a["vec_id"]), _vectors(b["embedding"]), np.asarray(b["vec_id"]), k=k, trees=trees, bits=bits, share=share)
        else:
            got = [[], [], []]
        return pa.table([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(cell, SCHEMA)
    ranked = found.selectExpr("*", "row_number() over (partition by query_id order by score desc, vec_id) as rank").where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_ann(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
