"""Sections of documents against comments of code, by the cosine of their vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = ("API", "class", "function", "method", "returns")
LEAST_SECTION, LEAST_COMMENT, SHOWN = 50, 20, 200
BLOCK = 8192
#: Rows whose products with a block are in a worker's memory at once: 32 MB.
STRIP = 512


def technical(text: Column) -> Column:
    """Whether one of the key words occurs in what is shown of the text."""
    shown, out = F.substring(text, 1, SHOWN), F.lit(False)
    for w in KEYWORDS:
        out = out | shown.contains(w)
    return out


def nearest(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of u the greatest cosine with a row of w, and the first such row; only a STRIP of the products is held at a time."""
    unit = lambda z: z / np.where((s := np.sqrt((z * z).sum(axis=1, keepdims=True))) > 0, s, 1)
    u, w, score, at = unit(u), unit(w).T, np.empty(len(u)), np.empty(len(u), dtype=np.int64)
    for k in range(0, len(u), STRIP):
        s = u[k : k + STRIP] @ w
        at[k : k + STRIP] = best = s.argmax(axis=1)
        score[k : k + STRIP] = s[np.arange(len(s)), best]
    return score, at


def best_matches(docs: DataFrame, code: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """doc_id, score, code_id: the code vector of greatest positive cosine; 0 and null without one.

    docs: doc_id, embedding; code: code_id, embedding.  Both sides are dealt
    into blocks of about `block` rows; a pair of blocks is one matrix product,
    and only the best of each block comes back.  Ties go to the smaller
    code_id; zero vectors and those of another length score 0.
    """
    n, m = code.count(), docs.count()
    a, b = max(1, -(-m // block)), max(1, -(-n // block))
    span = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = docs.select("doc_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.pmod(F.xxhash64("doc_id"), F.lit(a)).cast("int").alias("i")).withColumn("j", span(b))
    right = code.select("code_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.pmod(F.xxhash64("code_id"), F.lit(b)).cast("int").alias("j")).withColumn("i", span(a))

    def cell(x: pa.Table, y: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], t) for t in (x.schema.field("doc_id").type, pa.float64(), y.schema.field("code_id").type)], names=["doc_id", "score", "code_id"])]
        y = y.sort_by("code_id")
        for d in set(pc.list_value_length(x["embedding"]).unique().to_pylist()) & set(pc.list_value_length(y["embedding"]).unique().to_pylist()) - {0, None}:
            own, given = (t.filter(pc.equal(pc.list_value_length(t["embedding"]), d)) for t in (x, y))
            score, at = nearest(*(np.nan_to_num(np.asarray(pc.list_flatten(t["embedding"]).to_numpy(), dtype=float).reshape(-1, d)) for t in (own, given)))
            found = pa.table([own["doc_id"], pa.array(score), given["code_id"].take(pa.array(at))], names=["doc_id", "score", "code_id"])
            out.append(found.filter(pa.array(score > 0)))
        return pa.concat_tables(out)

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, code_id {code.schema['code_id'].dataType.simpleString()}"
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(lambda x, y: cell(x, y), kinds)
    best = found.groupBy("doc_id").agg(F.max("score").alias("score"), F.min_by("code_id", F.struct((-F.col("score")).alias("s"), "code_id")).alias("code_id"))
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), "code_id")


def mismatches(sections: DataFrame, matches: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Technical sections (doc_id, path, heading, text) whose best score is below the threshold."""
    out = sections.join(matches, "doc_id").where((F.col("score") < threshold) & technical(F.col("text")))
    return out.withColumns({"text": F.substring("text", 1, SHOWN), "suggestion": F.lit("Documentation may describe functionality not found in code")})


def embed(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """texts with the model's vectors, by Arrow batches; the model is loaded on the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = model([t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(run, f"{schema}, embedding array<float>")


def stats(index: DataFrame) -> DataFrame:
    """One row: sections and comments indexed."""
    return index.agg(F.count_if(F.col("kind") == "doc").alias("doc_sections"), F.count_if(F.col("kind") == "code").alias("code_comments"))
