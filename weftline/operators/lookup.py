"""Approximate lookups: the candidate nearest to a name."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import entry_likeness
from ..scratch import kept

DISTANCE = 3
#: Names up to this length meet by what deletions leave of them, longer ones by their pieces.
SHORT = 10


def _deletions(names: DataFrame, text: str, length: str, distance: int) -> DataFrame:
    """names with __left: what stays of the text when each set of at most `distance` characters is deleted."""
    out, before = names, F.lit(0)
    for k in range(distance):
        place = f"__p{k}"
        out = out.withColumn(place, F.explode(F.when(before == 0, F.sequence(F.lit(0), F.col(length))).when(before < F.col(length), F.sequence(before + 1, F.col(length)))))
        before = F.col(place)
    places = [f"__p{k}" for k in range(distance)]
    between = [f"substring({text}, {a} + 1, {b} - {a} - 1)" for a, b in zip(["0", *places], places)]
    return out.withColumn("__left", F.expr(f"concat({', '.join([*between, f'substring({text}, {places[-1]} + 1)'])})")).drop(*places)


def _paths(distance: int) -> list[tuple[int, ...]]:
    """(difference of lengths, three pieces, their shifts): the ways in which the first three whole pieces of distance + 3 lie.

    Every edit spoils the piece it falls into, one at a border the piece after
    it.  All pieces before the third whole one but these three are spoilt, so
    each run of g of them took g edits at least and shifts what follows by no
    more than it took; where none is spoilt, nothing shifts.
    """
    out = []
    for i, j, k in combinations(range(distance + 3), 3):
        spoilt = (i, j - i - 1, k - j - 1)
        for steps in product(range(-distance, distance + 1), repeat=3):
            taken = sum(max(g, abs(v)) for g, v in zip(spoilt, steps))
            if taken <= distance and not any(v and not g for g, v in zip(spoilt, steps)):
                shifts = (steps[0], steps[0] + steps[1], sum(steps))
                out += [(sum(steps) + rest, i, j, k, *shifts) for rest in range(taken - distance, distance - taken + 1)]
    return out


def nearest_names(targets: DataFrame, candidates: DataFrame, *, within: list[str] = (), distance: int = DISTANCE) -> DataFrame:
    """target, match for each distinct target with a candidate near enough.

    targets: target and the columns within; candidates: candidate, ord and the
    same columns.  The first candidate that differs in case only wins, else
    the least edit distance ignoring case, the first of equals.

    Distances are tried from 0 upward, and only targets without a match go on
    to the next, so names that lie close together don't meet all that are
    within the greatest distance.
    """
    keys, all_ = list(within), ["target", *within]
    own = kept(targets.select(*all_).distinct().withColumn("tl", F.lower("target")).withColumn("tn", F.char_length("tl")), "targets")
    given = candidates.groupBy("candidate", *keys).agg(F.min("ord").alias("ord")).withColumn("cl", F.lower("candidate")).withColumn("cn", F.char_length("cl"))
    if keys:
        given = given.join(own.select(*keys).distinct(), keys, "left_semi")
    given, found, left = kept(given, "candidates"), [], own
    for d in range(distance + 1):
        pairs = left.join(given.withColumnRenamed("cl", "tl"), ["tl", *keys]) if d == 0 else _meeting(left, given, keys, d)
        other_case = F.when(F.col("target") != F.col("candidate"), 0).otherwise(1) if d == 0 else F.lit(0)
        # a pair may meet at several keys, which doesn't matter to a minimum
        near = pairs.groupBy(*all_).agg(F.min_by("candidate", F.struct(other_case.alias("r"), F.col("ord").alias("o"))).alias("match"))
        found.append(kept(near, f"near{d}"))
        left = left.join(found[-1], all_, "left_anti")
        if found[-1] is not near and left.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _meeting(own: DataFrame, given: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Pairs at the distance, from targets without a candidate that is nearer.

    An equi-join, not a loop over all pairs, on keys that cover most of a
    name, so that a beginning which many names share makes no hot key.
    Candidates of up to SHORT characters meet by what is left when up to
    `distance` characters are deleted on each side.  A longer one is cut into
    distance + 3 pieces, of which three stay whole (pigeonhole), each at its
    place shifted by what was inserted and deleted before; the first three are
    the key.  Hashes are joined; what meets is compared by distance.  Only
    lengths that the other side has are looked up.
    """
    pieces = distance + 3
    asked, offered = ["target", *keys, "tl"], ["candidate", *keys, "cl", "ord"]
    about = lambda n: F.explode(F.sequence(F.col(n) - distance, F.col(n) + distance))
    given = given.join(F.broadcast(own.select("tn").distinct().select(about("tn").alias("cn")).distinct()), "cn", "left_semi")  # lengths are few
    lengths = own.withColumn("cn", about("tn")).join(F.broadcast(given.select("cn").distinct()), "cn")
    left = F.xxhash64(*keys, "__left").alias("__key")
    short = lengths.where(F.col("cn") <= SHORT).select(*asked, "tn").distinct(), given.where(F.col("cn") <= SHORT)
    short = _deletions(short[0], "tl", "tn", distance).select(*asked, left), _deletions(short[1], "cl", "cn", distance).select(*offered, left)

    def piece(text: str, k: str, shift: str = "0") -> str:
        return f"substring({text}, int({k} * cn div {pieces} + {shift} + 1), int(({k} + 1) * cn div {pieces} - {k} * cn div {pieces}))"

    whole = lambda text, shifts: F.xxhash64(*keys, "cn", "i", "j", "k", *[F.expr(piece(text, k, s)) for k, s in zip("ijk", shifts)]).alias("__key")
    names = ("diff", "i", "j", "k", "si", "sj", "sk")
    paths = F.broadcast(own.sparkSession.createDataFrame(pa.table({n: pa.array(v, pa.int32()) for n, v in zip(names, zip(*_paths(distance)))})))
    probe = lengths.where(F.col("cn") > SHORT).withColumn("diff", F.col("tn") - F.col("cn")).join(paths, "diff").where(" and ".join(f"{k} * cn div {pieces} + s{k} >= 0 and ({k} + 1) * cn div {pieces} + s{k} <= tn" for k in "ijk"))
    threes = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijk", t)]) for t in combinations(range(pieces), 3)]))
    long_ = probe.select(*asked, whole("tl", ("si", "sj", "sk"))), given.where(F.col("cn") > SHORT).select("*", threes.alias("t")).select("*", "t.*").select(*offered, whole("cl", "000"))
    probes = short[0].unionByName(long_[0]).withColumnsRenamed({k: f"__{k}" for k in keys})
    pairs = probes.join(short[1].unionByName(long_[1]), "__key").where(reduce(and_, [F.col(f"__{k}") == F.col(k) for k in keys], F.lit(True)))
    return pairs.where(F.levenshtein("tl", "cl", distance) == distance)


def nearest_entries(targets: DataFrame, entries: DataFrame, least: float = 0.7) -> DataFrame:
    """target, parent, match: the directory entry most like the target in its own parent.

    targets: target, parent; entries: entry, parent, ord.  An entry that
    differs in case only wins; likeness must reach `least`.  The join is on the
    parent, so a target meets one directory.
    """
    pairs = targets.select("target", "parent").distinct().join(entries, "parent").withColumn("tl", F.lower("target")).withColumn("el", F.lower("entry"))
    case = (F.col("tl") == F.col("el")) & (F.col("target") != F.col("entry"))
    pairs = pairs.withColumn("score", entry_likeness(F.col("tl"), F.col("el"))).withColumn("other_case", case).where((F.col("score") >= least) | case)
    rank = F.struct(F.col("other_case").cast("int").alias("c"), F.when(F.col("other_case"), 0.0).otherwise(F.col("score")).alias("s"), (-F.col("ord")).alias("o"))
    return pairs.groupBy("target", "parent").agg(F.max_by("entry", rank).alias("match"))
