"""Tables that a run writes for itself, to a folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where that isn't set, a local one serves in local mode (tests); on a
    cluster it is an error, as other machines could not read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("weftline.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("weftline.scratch", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted when the session's Python process ends."""
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    if not _PLACES:
        atexit.register(_forget)
    _PLACES.append((spark, path))
    return path


#: What this process has written; results may be read until it ends, so nothing goes before.
_PLACES: list[tuple[SparkSession, str]] = []


def clear(spark: SparkSession) -> None:
    """Deletes all tables written so far; results that weren't read yet can't be read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for owner, path in [p for p in _PLACES if p[0] is spark]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        _PLACES.remove((owner, path))


def _forget() -> None:
    for spark in {id(s): s for s, _ in _PLACES}.values():
        if spark._jsc is not None and spark.sparkContext._jsc is not None:  # a session that has been stopped can't delete
            try:
                clear(spark)
            except (Py4JError, OSError):
                pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again.

    The files outlive executors, so nothing is computed twice and what was
    random or order-dependent in df is fixed from here on.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once for all who read it, so that plans stay short; df itself on a cluster without a shared folder."""
    try:
        shared_dir(df.sparkSession)
    except ValueError:
        return df
    return written(df, name)
