"""Commit history: last commits, counts since a time, changed files.

commits: hash, ts, message, path, one row per commit and file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_commits(commits: DataFrame) -> DataFrame:
    """path, hash, ts, message of each file's last commit; of equal times the greater hash."""
    last = F.max(F.struct("ts", "hash", "message")).alias("c")
    return commits.groupBy("path").agg(last).select("path", F.col("c.hash").alias("hash"), F.col("c.ts").alias("ts"), F.col("c.message").alias("message"))


def changed_since(commits: DataFrame, since: Column) -> DataFrame:
    """path of the files with a commit at or after a time, distinct."""
    return commits.where(F.col("ts") >= since).select("path").distinct()


def changed_between(commits: DataFrame, first: str, last: str) -> DataFrame:
    """path of the files changed after one commit up to another, by their times."""
    times = commits.where(F.col("hash").isin(first, last)).groupBy().agg(F.max(F.when(F.col("hash") == first, F.col("ts"))).alias("a"), F.max(F.when(F.col("hash") == last, F.col("ts"))).alias("b"))
    return commits.join(F.broadcast(times)).where("ts > a and ts <= b").select("path").distinct()  # one row is broadcast


def commits_after(pairs: DataFrame, commits: DataFrame) -> DataFrame:
    """doc_path, code_path, ts, n: commits of a file at or after the document's last one, for documents with one.

    Joined on the file, never on the time alone; counted per file and time
    first, so that a busy file is a short table.
    """
    docs = last_commits(commits).select(F.col("path").alias("doc_path"), F.col("ts").alias("doc_ts"))
    per_time = commits.groupBy(F.col("path").alias("code_path"), "ts").agg(F.count("*").alias("k"))
    met = pairs.join(docs, "doc_path").join(per_time, "code_path", "left")
    return met.groupBy("doc_path", "code_path").agg(F.coalesce(F.sum(F.when(F.col("ts") >= F.col("doc_ts"), F.col("k"))), F.lit(0)).alias("n"))
