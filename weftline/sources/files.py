"""Files of a project as DataFrames: documents, source files, manifests, the listing."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, included
from ..operators.index import IGNORED, language_of
from .manifests import NAMES

FORMATS = {"markdown": ("md", "markdown"), "restructuredtext": ("rst",), "asciidoc": ("adoc", "asciidoc"), "plaintext": ("txt",)}


def format_of(path: Column) -> Column:
    """By extension in any case; plain text where unknown."""
    ext, out = F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1)), F.lit("plaintext")
    for name, exts in FORMATS.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


TREE = "path string, abs_path string, is_file boolean"


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, given as a URI or a local path, and the folder's place in it."""
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root)


def _below(files: fs.FileSystem, folder: str, recursive: bool) -> list[fs.FileInfo]:
    """What is in a folder; nothing if it can't be read."""
    try:
        return files.get_file_info(fs.FileSelector(folder, recursive=recursive))
    except OSError:
        return []


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), abs_path and is_file of every file and directory, whatever its name or size.

    The driver lists two levels; what is deeper is listed by tasks.
    """
    files, base = _opened(root)
    base = base.rstrip("/")
    seen = files.get_file_info(fs.FileSelector(base))
    folders = [i.path for i in seen if i.type == fs.FileType.Directory]
    second = [i for f in folders for i in _below(files, f, False)]
    deep = [i.path for i in second if i.type == fs.FileType.Directory]

    def row(path: str, kind: fs.FileType) -> tuple[str, str, bool]:
        return path[len(base) + 1 :], path, kind == fs.FileType.File

    def listed(batches):
        files, _ = _opened(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = [row(i.path, i.type) for i in _below(files, folder, True)]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 10_000])], names=["path", "abs_path", "is_file"])

    near = [row(i.path, i.type) for i in [*seen, *second]]
    out = spark.createDataFrame(pa.table([pa.array([r[k] for r in near], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["path", "abs_path", "is_file"]))
    if not deep:
        return out
    return out.unionByName(spark.createDataFrame(pa.table({"folder": deep})).repartition(min(len(deep), _tasks(spark))).mapInArrow(listed, TREE))


def read(spark: SparkSession, root: str, keep: Column, *, listed: DataFrame | None = None) -> DataFrame:
    """path (below root), abs_path, content of the files that keep accepts, empty and hidden ones too.

    Only those are opened, by their paths from the tree (listed, if given).
    Unreadable ones are left out; bytes that aren't UTF-8 are replaced.
    """

    def contents(batches):
        files, _ = _opened(root)
        for batch in batches:
            for path, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with files.open_input_stream(place) as f:
                        content = f.read().decode("utf-8", "replace")
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([place]), pa.array([content], pa.string())], names=["path", "abs_path", "content"])

    every = tree(spark, root) if listed is None else listed
    chosen = every.where("is_file").where(keep).select("path", "abs_path")
    return chosen.repartition(_tasks(spark), "path").mapInArrow(contents, "path string, abs_path string, content string")


def documents(spark: SparkSession, root: str, include: list[str], exclude: list[str] = (), *, listed: DataFrame | None = None) -> DataFrame:
    """path, abs_path, content, format of the documents; none without an include."""
    return read(spark, root, included(F.col("path"), include, exclude), listed=listed).withColumn("format", format_of(F.col("path")))


def code_files(spark: SparkSession, root: str, patterns: list[str], ignored: list[str] = IGNORED, *, listed: DataFrame | None = None) -> DataFrame:
    """path, content, language of source files, each read once; a file that two patterns name is there twice."""
    fits = [included(F.col("path"), [p], ignored) for p in patterns]
    rows = read(spark, root, included(F.col("path"), patterns, ignored), listed=listed)
    order = F.explode(F.array_compact(F.array(*[F.when(f, k) for k, f in enumerate(fits)]).cast("array<int>")))
    return rows.select("path", "content", language_of(F.col("path")).alias("language"), order.alias("pattern_ord"))


def manifests(spark: SparkSession, root: str, files: list[str], *, listed: DataFrame | None = None) -> DataFrame:
    """ord, name, content of the manifests named; later ones override earlier ones."""
    order = F.array_position(F.array(*map(F.lit, files)), F.col("path")) - 1
    return read(spark, root, F.col("path").isin(files), listed=listed).select(order.cast("int").alias("ord"), basename(F.col("path")).alias("name"), "content").where(F.col("name").isin(*NAMES))


def listing(paths: DataFrame, root: str = "") -> DataFrame:
    """path of every file and of all its ancestor directories, distinct; '' is the root."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return paths.select(F.explode(ancestors).alias("path")).distinct()
