"""Sharding by histogram sort.

Keys are (hash of the text, doc_id, row number), so equal texts are
neighbours.  The exact bytes below candidate boundaries are counted in every
partition, the probes between which a splitter must lie are refined until it
meets the tolerance, and then the rows are exchanged once.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, table, utf8_bytes, written

SHARDS = 8
PROBES = 512
#: A splitter may miss its target by this share of a shard to keep equal texts together.
TOLERANCE = 0.01
LEVELS = ("h", "doc", "row")


def _keys() -> tuple[Column, Column, Column]:
    """The key's levels: hash of the text, doc_id, row."""
    return F.coalesce(F.shiftrightunsigned(F.xxhash64("text"), 1), F.lit(0)), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.monotonically_increasing_id()


def _digest(documents: DataFrame) -> DataFrame:
    text = F.col("text")
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (utf8_bytes(text) + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        *[key.alias(level) for level, key in zip(LEVELS, _keys())],
    )


class _Cut:
    """A splitter on its way: the key interval that holds it, and the bytes below."""

    def __init__(self, target: float, lo: int, hi: int, total: int):
        self.target, self.fixed, self.below, self.inside = target, [], 0, total
        self.lo, self.hi, self.done = lo, hi, None  # done: key prefix below which rows go left


def _scope(cut: _Cut) -> Column:
    own = F.lit(True)
    for level, value in zip(LEVELS, cut.fixed):
        own = own & (F.col(level) == value)
    key = F.col(LEVELS[len(cut.fixed)])
    return own & (key >= cut.lo) & (key < cut.hi)


def _less(prefix: list[int], levels: tuple[str, ...] = LEVELS) -> Column:
    """Whether the row's key is less than the prefix, level by level."""
    out = F.lit(False)
    for level, value in reversed(list(zip(levels, prefix))):
        out = (F.col(level) < value) | ((F.col(level) == value) & out)
    return out


def splitters(keys: DataFrame, shards: int, *, probes: int = PROBES, tolerance: float = TOLERANCE) -> list[list[int]]:
    """Key prefixes; shard i takes the keys from splitter i-1 on and below splitter i.

    Each round counts the bytes in probes sub-intervals of each open interval
    (one aggregation, combined before the shuffle; at most probes * shards rows
    come back) and keeps the sub-interval that holds the target.  An interval
    of one hash value goes on by doc_id, then by row, unless one of its ends
    is within the tolerance: so equal texts stay together where that is near
    enough, and a large group is cut exactly.
    """
    total = keys.agg(F.sum("size").alias("s")).first()["s"] or 0
    if not total:
        return [[2**63 - 1]] * (shards - 1)
    slack = tolerance * total / shards
    cuts = [_Cut(total * i / shards, 0, 2**63 - 1, total) for i in range(1, shards)]
    while open_cuts := [c for c in cuts if c.done is None]:
        where, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, c in reversed(list(enumerate(open_cuts))):
            step = -(-(c.hi - c.lo) // probes)
            bucket = F.when(_scope(c), F.expr(f"(cast({LEVELS[len(c.fixed)]} as decimal(20,0)) - {c.lo}BD) div {step}BD")).otherwise(bucket)
            where = F.when(_scope(c), i).otherwise(where)
        # a key may lie in the intervals of several cuts: equal intervals are counted once
        scopes = {(tuple(c.fixed), c.lo, c.hi): i for i, c in reversed(list(enumerate(open_cuts)))}
        counted = keys.select(where.alias("cut"), bucket.alias("bucket"), "size").where("cut is not null").groupBy("cut", "bucket").agg(F.sum("size").alias("s")).collect()
        found: dict[int, dict[int, int]] = {}
        for r in counted:
            found.setdefault(r["cut"], {})[r["bucket"]] = r["s"]
        for c in open_cuts:
            _refine(c, found.get(scopes[tuple(c.fixed), c.lo, c.hi], {}), probes, slack, keys)
    return [c.done for c in cuts]


def _refine(c: _Cut, sizes: dict[int, int], probes: int, slack: float, keys: DataFrame) -> None:
    step = -(-(c.hi - c.lo) // probes)
    below = c.below
    for b in sorted(sizes):
        if below + sizes[b] >= c.target:
            break
        below += sizes[b]
    lo, hi, inside = c.lo + b * step, min(c.hi, c.lo + (b + 1) * step), sizes[b]
    left, right = c.target - below, below + inside - c.target
    last = len(c.fixed) == len(LEVELS) - 1
    if min(left, right) <= slack * (len(c.fixed) == 0) or (hi - lo == 1 and last):
        c.done = c.fixed + [lo if left <= right else hi]
    elif hi - lo > 1:
        c.lo, c.hi, c.below, c.inside = lo, hi, below, inside
    else:
        c.fixed, c.below, c.inside = c.fixed + [lo], below, inside
        level = LEVELS[len(c.fixed)]
        own = F.lit(True)
        for k, value in zip(LEVELS, c.fixed):
            own = own & (F.col(k) == value)
        ends = keys.where(own).agg(F.min(level).alias("lo"), F.max(level).alias("hi")).first()
        c.lo, c.hi = ends["lo"], ends["hi"] + 1


def shard_by_bytes(documents: DataFrame, shards: int = SHARDS, *, probes: int = PROBES, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law 'bytes': the shards' sums of sizes differ from the mean by the
    tolerance, or by the size of the row at the boundary.  Equal texts have
    one shard unless a boundary would miss by more than the tolerance.  Slots
    are gapless from 0 within a shard.  A null text has size 1 and a null
    text_crc32, a text of any length its whole size; null doc_ids and repeated
    rows are rows like others, told apart (a tie) by their place; an empty
    table gives no rows; other columns are not read, whatever their names.
    """
    spark = documents.sparkSession
    keys = written(_digest(documents), "sharding")
    cuts = splitters(keys, shards, probes=probes, tolerance=tolerance)
    shard = sum([F.when(_less(c), 0).otherwise(1) for c in cuts], F.lit(0)) if cuts else F.lit(0)
    # Fine ranges of the hash; a range that holds far more rows than others (a hot text) is split by row blocks.
    fine = 4 * partitions(spark)
    placed = keys.withColumn("shard", shard.cast("int")).withColumn("range", F.floor(F.col("h") / F.lit(float(2**63)) * fine).cast("int"))
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n")).collect()  # at most fine + shards - 1 rows
    usual = max(64, 4 * sum(r["n"] for r in counts) // max(1, fine))
    hot = [r["range"] for r in counts if r["n"] > usual]
    part = F.when(F.col("range").isin(hot), F.shiftrightunsigned("row", 33).cast("int")).otherwise(F.lit(0)) if hot else F.lit(0)
    placed = placed.withColumn("part", part)
    cells = placed.groupBy("shard", "range", "part").agg(F.count("*").alias("n"))
    by_shard = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "range", "part", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "range", "part").orderBy("h", "doc", "row")
    ranked = placed.withColumn("at", F.row_number().over(own) - 1)
    return ranked.join(offsets, ["shard", "range", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes whole rows below path, one folder shard=i for each shard that has rows, by the same splitters.

    Rows keep all their columns; one named shard is replaced by the folder's.
    Within a shard rows are dealt to tasks by a hash of their key, which a
    task that runs again finds unchanged.  documents must give the same rows
    in the same partitions each time, as a stored table does.
    """
    spark = documents.sparkSession
    own = tuple(f"__{k}" for k in LEVELS)
    cuts = splitters(written(_digest(documents), "sharding"), shards)
    rows = documents.withColumns({k: v for k, v in zip(own, _keys())})
    shard = sum([F.when(_less(c, own), 0).otherwise(1) for c in cuts], F.lit(0))
    parts = max(1, -(-partitions(spark) // shards))
    rows = rows.withColumn("shard", shard).withColumn("__part", F.pmod(F.xxhash64(*own), F.lit(parts)))
    rows.repartition(shards * parts, "shard", "__part").drop(*own, "__part").write.partitionBy("shard").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
