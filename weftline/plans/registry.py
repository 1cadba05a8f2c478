"""Registered queries over the corpora, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, similarity
from ..operators import extract, graph, history, index, lookup, report, score, semantic, snippets, state, validate
from ..scratch import kept
from ..sources import files, manifests
from ..sources.corpora import ROOT, corpus
from . import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = oracles.SQL


class Corpus:
    """The corpora of one folder, and what the operators make of them; lazy, but what a query reads more than once is written first."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return corpus(self.spark, self.dir, {"docs": "docs_syn", "code": "code_syn", "manifests": "manifests_syn", "commits": "commits_syn"}.get(name, name))

    @cached_property
    def texts(self) -> DataFrame:
        """The documents, composed once."""
        return kept(self.docs, "docs")

    @cached_property
    def listing(self) -> DataFrame:
        return kept(files.listing(self.docs.select("path").unionByName(self.code.select("path"))), "listing")

    @cached_property
    def index(self) -> DataFrame:
        return kept(index.symbols(self.code), "index")

    @cached_property
    def link_refs(self) -> DataFrame:
        return kept(extract.file_links(self.texts), "links")

    @cached_property
    def symbol_refs(self) -> DataFrame:
        return kept(extract.code_symbols(self.texts), "symbols")

    def packages(self) -> DataFrame:
        return manifests.effective_versions(self.manifests)

    def links(self) -> DataFrame:
        return validate.file_paths(self.link_refs, self.listing, ROOT)

    def versions(self, docs: DataFrame | None = None) -> DataFrame:
        return validate.versions(extract.versions(self.docs if docs is None else docs), self.packages())

    def names(self) -> DataFrame:
        return validate.symbols(self.symbol_refs, self.index)

    def results(self) -> DataFrame:
        """Links, versions, packages and symbols with their verdicts."""
        parts = [self.links(), self.versions(self.texts), validate.packages(extract.packages(self.texts), manifests.dependencies(self.manifests)), self.names()]
        cols = ["path", "type", "value", "line", "valid", "skipped", "severity", "message", "suggestion"]
        out = parts[0].select(cols)
        for p in parts[1:]:
            out = out.unionByName(p.select(cols))
        return out

    def edges(self) -> DataFrame:
        refs = self.link_refs.unionByName(self.symbol_refs, allowMissingColumns=True)
        return graph.edges(refs, self.index, ROOT)

    def changed(self) -> DataFrame:
        """Files with a commit in the last day of the history."""
        last = self.commits.agg(F.max("ts").alias("m"))
        return self.commits.join(F.broadcast(last)).where("ts >= m - interval 1 day").select("path").distinct()  # one row is broadcast

    @cached_property
    def pairs(self) -> DataFrame:
        return kept(graph.pairs(self.edges()), "pairs")

    def validity(self) -> DataFrame:
        return score.validity(self.texts, self.results())

    def time_delta(self) -> DataFrame:
        return score.time_delta(self.texts, self.pairs, self.commits)

    def churn(self) -> DataFrame:
        return score.churn(self.texts, self.pairs, self.commits)

    def coverage(self) -> DataFrame:
        return score.coverage(self.texts, self.symbol_refs, self.pairs, graph.code_symbols(self.index))

    def scores(self) -> DataFrame:
        factors = {"validity": self.validity(), "time_delta": self.time_delta(), "churn": self.churn(), "coverage": self.coverage()}
        return score.doc_scores(self.texts, [kept(f, k) for k, f in factors.items()])


def query(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
    return f


@query
def version_mismatch_summary(c):
    return score.summary(c.versions())


@query
def version_mismatches(c):
    return c.versions().select("path", "line", "technology", "version", "actual", "valid", "message", "suggestion")


@query
def extract_file_links(c):
    return extract.file_links(c.docs).select("path", "value", "link_text", "line", "line_ref", "raw")


@query
def extract_urls(c):
    return extract.urls(c.docs).select("path", "value", "line", "raw")


@query
def extract_versions(c):
    return extract.versions(c.docs).select("path", "technology", "version", "line", "raw")


@query
def extract_dependencies(c):
    return extract.packages(c.docs).select("path", "value", "ecosystem", "line")


@query
def extract_tree_paths(c):
    return extract.trees(c.docs).select("path", "value", "line", "is_illustrative")


@query
def extract_code_patterns(c):
    return extract.code_symbols(c.docs).select("path", "value", "kind", "language", "line", "is_illustrative")


@query
def extract_imports(c):
    found = snippets.imports(snippets.blocks(c.docs))
    return found.select("path", "value", "line", "language", "link_text", F.array_join("import_specifiers", ";").alias("specifiers"))


@query
def extract_calls(c):
    found = snippets.calls(snippets.blocks(c.docs))
    return found.select("path", "value", "line", "language", F.col("link_text").alias("arity"), F.array_join("argument_names", ";").alias("names"))


@query
def extract_config_keys(c):
    return snippets.config_keys(snippets.blocks(c.docs)).select("path", "value", "line", F.col("link_text").alias("type_name"))


@query
def index_symbols(c):
    return index.symbols(c.code).select("symbol", "file_path", "kind", "language")


@query
def index_exports(c):
    return index.exports(c.code)


@query
def index_signatures(c):
    return index.signatures(c.code).select("name", F.array_join("params", ",").alias("params"), "required", "file_path")


@query
def index_interface_keys(c):
    return index.interface_keys(c.code)


@query
def index_comments(c):
    return index.comments(c.code).select("path", "kind", "text", "symbol")


@query
def doc_sections(c):
    return extract.sections(c.docs)


@query
def detect_formats(c):
    return c.docs.select("path", files.format_of(F.col("path")).alias("format"), index.language_of(F.col("path")).alias("language"))


@query
def file_listing(c):
    return c.listing


@query
def parse_manifest_versions(c):
    return manifests.versions(c.manifests).select("ord", "name", "version")


@query
def effective_versions(c):
    return c.packages()


@query
def parse_manifest_dependencies(c):
    return manifests.dependencies(c.manifests)


@query
def validate_file_paths(c):
    return c.links().select("path", "value", "line", "valid", "skipped", "severity", "message", "suggestion", "resolved_path")


@query
def validate_directories(c):
    found = validate.directories(kept(extract.trees(c.docs), "trees"), c.listing, ROOT)
    return found.select("path", "value", "line", "valid", "skipped", "message", "suggestion", "found_at")


@query
def validate_symbols(c):
    return c.names().select("path", "value", "kind", "valid", "skipped", "message", "suggestion", F.array_join("found_in", ",").alias("found_in"))


@query
def validate_dependencies(c):
    found = validate.packages(extract.packages(c.docs), manifests.dependencies(c.manifests))
    return found.select("path", "value", "valid", "severity", "message")


@query
def validate_urls(c):
    return validate.url_verdicts(c.urls, c.probe_results)


@query
def urls_to_probe(c):
    return validate.to_probe(c.urls, None, 0)


@query
def validate_imports(c):
    refs = kept(snippets.imports(snippets.blocks(c.docs)), "imports")
    return validate.imports(refs, c.code, c.listing, kept(index.exports(c.code), "exports")).select("path", "value", "line", "valid", "skipped", "message", "suggestion", "resolved_path")


@query
def validate_calls(c):
    refs = snippets.calls(snippets.blocks(c.docs))
    return validate.calls(refs, index.signatures(c.code)).select("path", "value", "line", "valid", "skipped", "message", "suggestion")


@query
def validate_config_keys(c):
    refs = kept(snippets.config_keys(snippets.blocks(c.docs)), "config_keys")
    return validate.config_keys(refs, kept(index.interface_keys(c.code), "keys")).select("path", "value", "line", "valid", "skipped", "message", "suggestion")


@query
def nearest_string(c):
    names = F.concat(F.lit("Fn_"), F.substring(F.md5("c_name"), 1, 9))
    given = c.customer.select(names.alias("candidate"), F.col("c_custkey").alias("ord"))
    typed = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.substring(names, 1, 6), F.lit("zz"), F.substring(names, 8, 9))).when(F.col("c_custkey") % 3 == 1, F.upper(names)).otherwise(F.concat(F.lit("g"), F.substring(F.md5(names), 1, 8)))
    return lookup.nearest_names(c.customer.select(typed.alias("target")), given)


@query
def similarity_ratio(c):
    a, b = F.col("p_name"), F.col("p_type")
    return c.part.select("p_partkey", F.levenshtein(a, b).alias("distance"), F.round(similarity.ratio(a, b), 9).alias("ratio"), F.round(similarity.entry_likeness(F.lower(F.concat(a, F.lit("s"))), F.lower(F.concat(a, F.lit(".ts")))), 9).alias("likeness"))


@query
def graph_edges(c):
    return c.edges()


@query
def docs_for_code(c):
    return graph.docs_for_code(c.edges()).select("code_path", F.array_join("docs", ",").alias("docs"))


@query
def code_for_doc(c):
    return graph.code_for_doc(c.edges()).select("doc_path", F.array_join("code_files", ",").alias("code_files"))


@query
def affected_docs(c):
    return graph.affected_docs(c.edges(), c.changed())


@query
def change_summary(c):
    out = graph.change_summary(c.edges(), c.changed(), history.last_commits(c.commits))
    return out.select("code_path", F.size("docs").alias("n_docs"), "hash", "message")


@query
def last_commit(c):
    return history.last_commits(c.commits)


@query
def commits_after_doc(c):
    return history.commits_after(graph.pairs(c.edges()), c.commits)


@query
def changed_since(c):
    return c.changed()


@query
def changed_between(c):
    ends = c.commits.agg(F.min(F.struct("ts", "hash"))["hash"].alias("a"), F.max(F.struct("ts", "hash"))["hash"].alias("b")).first()  # one row
    return history.changed_between(c.commits, ends["a"], ends["b"])


@query
def graph_validity(c):
    key = F.col("o_orderkey")
    choice = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (key % n + 1).cast("int"))
    meta = c.orders.select("o_orderkey", F.when(key % 7 == 0, None).when(key % 7 == 1, 0).otherwise(key * 10_000).cast("long").alias("build_ts_ms"), choice(4, None, "abc", "zzz", "").alias("config_hash"), choice(5, None, "c1", "c2", None, "c1").alias("git_commit"))
    here, nowhere = (state.graph_is_valid(meta, "abc", commit, 300_000_000).select("o_orderkey", F.col("valid").alias(name)) for commit, name in (("c1", "valid_at_commit"), (None, "valid_by_age")))
    return here.join(nowhere, "o_orderkey")


@query
def embeddings_missing(c):
    texts = c.documents.select(F.coalesce("lang", F.lit("none")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    cached = texts.where("doc_id % 3 = 0").select(F.concat("kind", F.lit(":"), F.md5("text")).alias("key"))
    return state.missing_embeddings(texts, cached).select("kind", "key")


@query
def cache_fresh(c):
    cache = c.orders.select(F.concat(F.lit("https://x.org/"), F.col("o_orderkey").cast("string")).alias("url"), (F.col("o_orderkey") * 1000).alias("ts_ms"))
    return state.fresh(cache, 4_000_000, 3600)


@query
def factor_validity(c):
    return c.validity()


@query
def factor_time_delta(c):
    return c.time_delta()


@query
def factor_churn(c):
    return c.churn()


@query
def factor_coverage(c):
    return c.coverage()


@query
def doc_scores(c):
    return c.scores().select("path", *score.WEIGHTS, "total_score", "grade")


@query
def project_score(c):
    return score.project_score(c.scores())


@query
def results_summary(c):
    return score.summary(c.results())


@query
def issues_by_doc(c):
    return score.issues(c.results()).groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("errors"), F.min("line").alias("first_line"))


@query
def incremental_changed(c):
    docs = c.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return state.changed_docs(docs, c.hash_state).select("path")


@query
def incremental_state(c):
    return state.new_state(c.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query
def incremental_stats(c):
    docs = c.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    n = docs.agg(F.count("*").alias("n")).join(F.broadcast(state.changed_docs(docs, c.hash_state).agg(F.count("*").alias("k"))))  # one row is broadcast
    return n.select(state.incremental_stats(F.col("n"), F.col("k")).alias("s")).select("s.*")


@query
def prune_newest(c):
    return state.keep_newest(c.events.select(F.concat("event_type", F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), "value"), "key", "seq", 50)


@query
def semantic_best_match(c):
    half = lambda k, name: c.embeddings.where(F.col("vec_id") % 2 == k).select(F.col("vec_id").alias(name), "embedding")
    return semantic.best_matches(half(1, "doc_id"), half(0, "code_id")).select("doc_id", F.round("score", 6).alias("score"), "code_id")


@query
def semantic_mismatches(c):
    half = lambda k, name: c.embeddings.where(F.col("vec_id") % 2 == k).select(F.col("vec_id").alias(name), "embedding")
    words = F.element_at(F.array(*map(F.lit, ["the function", "a class", "no such", "API of it", "it returns", "methods"])), (F.col("vec_id") % 6 + 1).cast("int"))
    texts = c.embeddings.where("vec_id % 2 = 1").select(F.col("vec_id").alias("doc_id"), words.alias("text"))
    return semantic.mismatches(texts, semantic.best_matches(half(1, "doc_id"), half(0, "code_id")), 0.45).select("doc_id", "text", F.round("score", 6).alias("score"), "suggestion")


@query
def cosine_pairs(c):
    v = c.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(c.embeddings.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y")), "a")
    return v.select("a", F.round(similarity.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query
def illustrative_flags(c):
    value = F.concat(F.element_at(F.array(*map(F.lit, ["src/", "my-app/", "x/{id}/", "foo/", "lib/second.", "a/<b>/"])), (F.col("p_partkey") % 6 + 1).cast("int")), F.regexp_replace("p_name", " ", ""))
    word = F.element_at(F.array(*map(F.lit, ["GET", "Modal", "Mymodule", "ab", "Widget", "testing"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return c.part.select("p_partkey", paths.example_path(value).alias("path_flag"), paths.example_symbol(word).alias("symbol_flag"))


@query
def path_within_root(c):
    p = F.concat(F.lit("/project/docs/"), F.element_at(F.array(*map(F.lit, ["../src/", "./", "../../", "../../projectExtra/", "a/../b/", "../../project/"])), (F.col("p_partkey") % 6 + 1).cast("int")), F.regexp_replace("p_name", " ", "_"))
    full = paths.normalized(p)
    return c.part.select("p_partkey", full.alias("full_path"), paths.within_root(full, "/project").alias("inside"))


@query
def markdown_escape(c):
    return c.docs.select("path", report.escape_cell(F.col("content")).alias("cell"))


@query
def report_markdown(c):
    return report.issue_tables(score.issues(c.results()))


@query
def report_json(c):
    return report.json_lines(score.issues_by_doc(c.results()))
