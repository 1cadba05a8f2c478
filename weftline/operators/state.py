"""State between runs: content hashes, caches with an age, bounded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_docs(docs: DataFrame, state: DataFrame) -> DataFrame:
    """docs that are new or whose md5 differs from the state (path, md5)."""
    old = state.select("path", F.col("md5").alias("__old"))
    return docs.join(old, "path", "left").where(~F.md5(F.col("content").cast("binary")).eqNullSafe(F.col("__old"))).drop("__old")


def new_state(docs: DataFrame) -> DataFrame:
    """path, md5 of this run's documents; paths no longer seen vanish."""
    return docs.select("path", F.md5(F.col("content").cast("binary")).alias("md5"))


def incremental_stats(total: Column, changed: Column) -> Column:
    skipped = total - changed
    share = F.when(total > 0, F.floor(skipped / total * 100 + 0.5)).otherwise(0).cast("long")
    return F.struct(total.alias("total"), changed.alias("changed"), skipped.alias("skipped"), share.alias("percent_skipped"))


def keep_newest(table: DataFrame, key: str, seq: str, most: int) -> DataFrame:
    """The `most` keys put in last; a key put in again keeps its first place and its last value.

    Places are numbered by a global rank of distinct keys, cut by a limit, not a window over all rows.
    """
    if most < 0:
        return table
    first = table.groupBy(key).agg(F.min(seq).alias("__first"), F.max(seq).alias("__last"))
    kept = first.orderBy(F.desc("__first"), F.desc(key)).limit(most)
    return table.join(kept, key).where(F.col(seq) == F.col("__last")).drop("__first", "__last")


def fresh(cache: DataFrame, now_ms: int, seconds: int = 3600) -> DataFrame:
    return cache.where(F.lit(now_ms) - F.col("ts_ms") < seconds * 1000)


def graph_is_valid(meta: DataFrame, config_hash: str, commit: str | None, now_ms: int, max_age_ms: int = 86_400_000) -> DataFrame:
    """meta (build_ts_ms, config_hash, git_commit) with valid: built, for this configuration, at this commit or lately."""
    built = F.col("build_ts_ms").isNotNull() & (F.col("build_ts_ms") != 0)
    same = F.col("config_hash").isNull() | (F.col("config_hash") == "") | (F.col("config_hash") == config_hash)
    here = F.lit(commit)
    age = F.when(here.isNotNull() & F.col("git_commit").isNotNull(), F.col("git_commit") == here).otherwise(F.lit(now_ms) - F.col("build_ts_ms") < max_age_ms)
    return meta.withColumn("valid", F.coalesce(built & same & age, F.lit(False)))


def missing_embeddings(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """texts (kind, text) whose key isn't in the cache, each once, with the key."""
    keyed = texts.select("kind", "text", F.concat("kind", F.lit(":"), F.md5(F.col("text").cast("binary"))).alias("key")).dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


