"""Continuous checking: new and changed files of a folder as a stream of small batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.paths import included
from ..sources.files import format_of


def document_stream(spark: SparkSession, root: str, include: list[str], exclude: list[str] = (), per_batch: int = 1000) -> DataFrame:
    """path, content, format of files as they come."""
    rows = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(per_batch)).text(root, wholetext=True)
    rows = rows.select(F.regexp_replace("_metadata.file_path", r"^[a-z]+:/+", "/").alias("abs_path"), F.col("value").alias("content"))
    path = F.substring("abs_path", F.lit(len(root.rstrip("/")) + 2), F.lit(1 << 20))
    return rows.select(path.alias("path"), "content").where(included(F.col("path"), include, exclude)).withColumn("format", format_of(F.col("path")))


def check_stream(stream: DataFrame, check: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs check on each batch and appends its rows with batch_id to the table at out.

    A batch that is run again after a failure replaces its own rows, as they
    lie in a folder of their own.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        check(df).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
