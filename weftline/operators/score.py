"""Scores of documents: four factors from 0 to 100, their weighted sum, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import half_up
from . import history

WEIGHTS = {"reference_validity": 0.4, "git_time_delta": 0.3, "code_change_frequency": 0.15, "symbol_coverage": 0.15}
GRADES = {"A": 90, "B": 80, "C": 70, "D": 60}


def bucket(valid: Column, skipped: Column, severity: Column) -> Column:
    """skipped, valid, error or warning; an invalid reference of severity info counts as valid."""
    return F.when(skipped, "skipped").when(valid | (severity == "info"), "valid").when(severity == "error", "error").when(severity == "warning", "warning").otherwise("valid")


def summary(results: DataFrame) -> DataFrame:
    """One row: total, valid, errors, warnings, skipped."""
    b = bucket(F.col("valid"), F.col("skipped"), F.col("severity"))
    return results.select(b.alias("b")).agg(F.count("*").alias("total"), *[F.count_if(F.col("b") == k).alias(n) for k, n in (("valid", "valid"), ("error", "errors"), ("warning", "warnings"), ("skipped", "skipped"))])


def issues(results: DataFrame) -> DataFrame:
    """Errors and warnings only."""
    b = bucket(F.col("valid"), F.col("skipped"), F.col("severity"))
    return results.withColumn("bucket", b).where("bucket in ('error', 'warning')").drop("bucket")


def issues_by_doc(results: DataFrame) -> DataFrame:
    """path, issues: of each document with any, in the order of its text."""
    row = F.struct("line", "type", "value", "severity", "message", "suggestion")
    return issues(results).groupBy("path").agg(F.sort_array(F.collect_list(row)).alias("issues"))


def grade(score: Column, limits: dict[str, float] = GRADES) -> Column:
    out = F.lit("F")
    for g, least in sorted(limits.items(), key=lambda x: x[1]):
        out = F.when(score >= least, g).otherwise(out)
    return out


def validity(docs: DataFrame, results: DataFrame) -> DataFrame:
    """path, reference_validity: share of references without an error; 100 without references."""
    b = bucket(F.col("valid"), F.col("skipped"), F.col("severity"))
    own = results.groupBy("path").agg(F.count("*").alias("n"), F.count_if(b == "error").alias("e"))
    return docs.select("path").join(own, "path", "left").select("path", F.when(F.coalesce("n", F.lit(0)) == 0, 100).otherwise(half_up((F.col("n") - F.col("e")) / F.col("n") * 100)).cast("long").alias("reference_validity"))


def time_delta(docs: DataFrame, pairs: DataFrame, commits: DataFrame | None) -> DataFrame:
    """path, git_time_delta: decays by the days from the document's last commit to its code's.

    75 without a repository or for code outside it, 50 for a document outside it, 100 without code or when newer.
    """
    if commits is None:
        return docs.select("path", F.lit(75).cast("long").alias("git_time_delta"))
    last = history.last_commits(commits)
    code = pairs.join(last.select(F.col("path").alias("code_path"), "ts"), "code_path", "left").groupBy(F.col("doc_path").alias("path")).agg(F.max("ts").alias("code_ts"), F.lit(True).alias("has"))
    out = docs.select("path").join(last.select("path", "ts"), "path", "left").join(code, "path", "left")
    days = (F.unix_millis(F.col("code_ts").cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp"))) / F.lit(86_400_000.0)
    score = F.when(F.col("ts").isNull(), 50).when(F.col("has").isNull(), 100).when(F.col("code_ts").isNull(), 75).when(F.col("ts") >= F.col("code_ts"), 100).otherwise(F.greatest(F.lit(0), half_up(100 * F.exp(-0.02 * days))))
    return out.select("path", score.cast("long").alias("git_time_delta"))


def churn(docs: DataFrame, pairs: DataFrame, commits: DataFrame | None) -> DataFrame:
    """path, code_change_frequency: decays by the most commits to one file since the document's last, to 40."""
    if commits is None:
        return docs.select("path", F.lit(75).cast("long").alias("code_change_frequency"))
    known = history.last_commits(commits).select("path", F.lit(True).alias("tracked"))
    most = history.commits_after(pairs, commits).groupBy(F.col("doc_path").alias("path")).agg(F.max("n").alias("n"))
    linked = pairs.select(F.col("doc_path").alias("path"), F.lit(True).alias("has")).distinct()
    out = docs.select("path").join(linked, "path", "left").join(known, "path", "left").join(most, "path", "left")
    score = F.when(F.col("has").isNull(), 100).when(F.col("tracked").isNull(), 50).when(F.coalesce("n", F.lit(0)) == 0, 100).otherwise(F.greatest(F.lit(40), half_up(40 + 60 * F.exp(-0.03 * F.col("n")))))
    return out.select("path", score.cast("long").alias("code_change_frequency"))


def coverage(docs: DataFrame, refs: DataFrame, pairs: DataFrame, code_symbols: DataFrame) -> DataFrame:
    """path, symbol_coverage: share of the symbols of a document's files that it names; 100 without any."""
    said = refs.where("type = 'code-pattern'").select(F.col("path").alias("doc_path"), F.col("value").alias("symbol"), F.lit(1).alias("hit")).distinct()
    own = pairs.join(code_symbols, "code_path").join(said, ["doc_path", "symbol"], "left").groupBy(F.col("doc_path").alias("path")).agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    return docs.select("path").join(own, "path", "left").select("path", F.when(F.coalesce("n", F.lit(0)) == 0, 100).otherwise(half_up(F.col("k") / F.col("n") * 100)).cast("long").alias("symbol_coverage"))


def doc_scores(docs: DataFrame, factors: list[DataFrame], weights: dict[str, float] | None = None, limits: dict[str, float] | None = None) -> DataFrame:
    """path, the factors, total_score and grade; the grade is of the unrounded sum."""
    weights = WEIGHTS | (weights or {})
    out = docs.select("path")
    for f in factors:
        out = out.join(f, "path", "left")
    total = sum((F.col(k) * F.lit(float(w)) for k, w in weights.items()), F.lit(0.0))
    return out.withColumn("raw", F.round(total, 9)).withColumns({"total_score": half_up(F.col("raw")), "grade": grade(F.col("raw"), GRADES | (limits or {}))}).drop("raw")


def project_score(scores: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """One row: project_score, project_grade, total and the number of each grade; 100 and A without documents."""
    mean = F.coalesce(F.avg("total_score"), F.lit(100.0))
    counts = [F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"]
    return scores.agg(half_up(mean).alias("project_score"), grade(mean, GRADES | (limits or {})).alias("project_grade"), F.count("*").alias("total"), *counts)
