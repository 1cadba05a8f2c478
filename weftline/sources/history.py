"""Commit history read from a repository by one process on the driver, never one a file."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "\x1e"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """hash, ts, message, path of every change; empty where root is no repository or git isn't there."""
    schema = "hash string, ts timestamp, message string, path string"
    try:
        out = subprocess.run(["git", "-C", root, "log", "--name-only", f"--pretty=format:{MARK}%H%x00%ct%x00%s"], capture_output=True, text=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return spark.createDataFrame([], schema)
    rows = []
    for part in out.split(MARK)[1:]:
        head, _, files = part.partition("\n")
        digest, seconds, subject = head.split("\0", 2)
        rows += [(digest, int(seconds), subject, f) for f in files.split("\n") if f]
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(rows, "hash string, s long, message string, path string").select("hash", F.timestamp_seconds("s").alias("ts"), "message", "path")


def current_commit(root: str) -> str | None:
    try:
        return subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip() or None
    except (OSError, subprocess.CalledProcessError):
        return None
