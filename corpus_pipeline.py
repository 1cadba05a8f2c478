"""The corpus pipeline: documents through five stages, each written and read again.

toxicity drops what it rejects; near_duplicates keeps one row of each group,
that of the smallest doc_id; secrets are replaced in the texts; mixing repeats and drops
documents to meet the sources' targets; the last stage encodes the texts.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing, ngram_join, secrets, sentencepiece_codec, toxicity
from weftline.llm._common import keyed, numbers_of, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to labels, doesn't reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: that of the smallest doc_id, null last, and of equal ids the first."""
    rows = keyed(docs)
    linked = ngram_join.similar(rows, doc_id="__key").where("n_similar > 0").select(F.col("doc_id").alias("__key"), "component_id")
    linked = written(linked.join(rows.select("__key", "doc_id"), "__key"), "linked")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key"))["__key"]
    kept = linked.groupBy("component_id").agg(least.alias("__key")).select("__key")
    dropped = numbers_of(linked.join(kept, "__key", "left_anti").select("__key", F.lit(1).alias("number")), "dropped")
    return rows.where(dropped("__key") == 0).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind, and n_chars to match."""
    out = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    rows = keyed(docs)
    copies = numbers_of(mixing.mix(rows, key="__key").where("copies > 0").select("__key", F.col("copies").alias("number")), "copies")
    return rows.withColumn("__copies", copies("__key")).withColumn("__time", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip of each row."""
    return sentencepiece_codec.encode(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("sentencepiece", encode)]

#: Fitted weights and balanced sampling have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
