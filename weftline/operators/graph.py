"""The graph of documents and the code that they refer to: one table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import document_dir, resolved


def edges(refs: DataFrame, index: DataFrame, root: str) -> DataFrame:
    """doc_path, code_path, type, value, line: links to indexed files, and symbols to all files that declare them.

    Two equi-joins; files without a symbol are not in the index.
    """
    files = index.select(F.col("file_path").alias("code_path")).distinct()
    full = resolved(document_dir(root, F.col("path")), F.col("value"))
    links = refs.where("type = 'file-path'").withColumn("code_path", F.when(full.startswith(root + "/"), F.substring(full, F.lit(len(root) + 2), F.lit(1 << 20))))
    by_link = links.join(files, "code_path", "left_semi").select(F.col("path").alias("doc_path"), "code_path", "type", "value", "line")
    declared = index.select(F.col("symbol").alias("value"), F.col("file_path").alias("code_path")).distinct()
    by_name = refs.where("type = 'code-pattern'").join(declared, "value").select(F.col("path").alias("doc_path"), "code_path", "type", "value", "line")
    return by_link.unionByName(by_name)


def code_symbols(index: DataFrame) -> DataFrame:
    """code_path, symbol: the distinct symbols of each file."""
    return index.select(F.col("file_path").alias("code_path"), "symbol").distinct()


def pairs(edges_: DataFrame) -> DataFrame:
    """doc_path, code_path: adjacency both ways."""
    return edges_.select("doc_path", "code_path").distinct()


def docs_for_code(edges_: DataFrame) -> DataFrame:
    return pairs(edges_).groupBy("code_path").agg(F.sort_array(F.collect_set("doc_path")).alias("docs"))


def code_for_doc(edges_: DataFrame) -> DataFrame:
    return pairs(edges_).groupBy("doc_path").agg(F.sort_array(F.collect_set("code_path")).alias("code_files"))


def affected_docs(edges_: DataFrame, changed: DataFrame) -> DataFrame:
    """doc_path of the documents that refer to a changed path."""
    return pairs(edges_).join(changed.select(F.col("path").alias("code_path")), "code_path", "left_semi").select("doc_path").distinct()


def change_summary(edges_: DataFrame, changed: DataFrame, last: DataFrame) -> DataFrame:
    """code_path, docs, hash, ts, message of the changed files that documents refer to."""
    own = docs_for_code(edges_.join(changed.select(F.col("path").alias("code_path")).distinct(), "code_path", "left_semi"))
    return own.join(last.withColumnRenamed("path", "code_path"), "code_path", "left")
