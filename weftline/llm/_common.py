"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import dataset
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import clear, shared_dir, shared_path, written  # noqa: F401

#: White space of the contracts: space and the controls from tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch between the JVM and Python, where each holds a whole text.
BATCH = 512


def whole_texts(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to few rows, unless it has a number of its own: thousands of texts would fill a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: monotonically_increasing_id counts the rows of a partition in so many bits, and the partitions above them.
ROW_BITS = 33


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a __key of each row's own, written so that it stays: ids may be null or repeated."""
    return written(docs.withColumn("__key", F.monotonically_increasing_id()), "keyed")


def numbers_of(facts: DataFrame, name: str) -> Callable[[Column], Column]:
    """A function of keys that gives the number of each in facts(__key, number), 0 for those that aren't there.

    Keys are those of `keyed`, each once at most.  The numbers go to the rows
    that ask, so rows with whole texts are not exchanged, however many numbers
    there are: folder pid=i of the shared folder holds those of the keyed
    partition i, and a task reads the folders of the keys that it meets, one
    at a time.
    """
    path = shared_path(facts.sparkSession, name)
    sent = facts.select(F.shiftright("__key", ROW_BITS).alias("pid"), F.col("__key").alias("key"), F.col("number").cast("int").alias("number"))
    sent.repartition("pid").write.partitionBy("pid").parquet(path)

    def folder(pid: int) -> tuple[np.ndarray, np.ndarray]:
        files, root = pa_fs.FileSystem.from_uri(f"{path}/pid={pid}") if "://" in path or path.startswith("file:") else (pa_fs.LocalFileSystem(), f"{path}/pid={pid}")
        found = [i.path for i in files.get_file_info(pa_fs.FileSelector(root, allow_not_found=True)) if i.path.endswith(".parquet")]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        t = dataset.dataset(found, filesystem=files, format="parquet").to_table(columns=["key", "number"]).sort_by("key")
        return t["key"].to_numpy(), t["number"].to_numpy()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, own, number = None, None, None
        for batch in batches:
            keys = batch.to_numpy(np.int64)
            out, pids = np.zeros(len(keys), np.int32), keys >> ROW_BITS
            for pid in np.unique(pids):
                if pid != held:
                    held, (own, number) = pid, folder(pid)
                if len(own):
                    asked = np.flatnonzero(pids == pid)
                    at = np.minimum(np.searchsorted(own, keys[asked]), len(own) - 1)
                    out[asked] = np.where(own[at] == keys[asked], number[at], 0)
            yield pd.Series(out)

    return F.pandas_udf(run, "int", functionType=F.PandasUDFType.SCALAR_ITER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    """Number of runs without white space; 0 for null.

    A run begins where a non-blank follows a blank or the start, so one
    split of the trimmed text is counted instead of extracting each word.
    """
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
