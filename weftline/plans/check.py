"""A whole check: scan, extract, validate, score, report."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as settings
from ..operators import extract, graph, history, index, report, score, semantic, snippets, state, validate
from ..plugins import Plugin
from ..sources import files, manifests
from ..sources import history as log
from ..sources import probe as live

EMBEDDINGS = "key string, embedding array<float>, ts_ms long"
MOST_EMBEDDINGS = 20_000
RESULT = ["path", "type", "value", "line", "valid", "skipped", "severity", "message", "suggestion"]


def state_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version of the table at path, or an empty one where there is none."""
    versions = sorted((v for v in os.listdir(path) if os.path.exists(os.path.join(path, v, "_SUCCESS"))), key=int) if os.path.isdir(path) else []
    return spark.read.schema(schema).parquet(os.path.join(path, versions[-1])) if versions else spark.createDataFrame([], schema)


def replace_table(df: DataFrame, path: str, version: int) -> None:
    """Writes a new version; the one before stays, as df and what is cached may be read from it."""
    df.write.mode("overwrite").parquet(os.path.join(path, str(version)))
    for old in sorted(os.listdir(path), key=int)[:-2]:
        shutil.rmtree(os.path.join(path, old), ignore_errors=True)


@dataclass
class Check:
    """One run over a project; DataFrames are lazy, and what a run shares is cached once.

    Documents and code may be given as DataFrames (path, content, format or
    language) instead of being read from the root.
    """

    spark: SparkSession
    config: dict
    given: dict[str, DataFrame] = field(default_factory=dict)
    plugins: list[Plugin] = field(default_factory=list)
    model: Callable[[list[str]], list[list[float]]] | None = None
    now_ms: int = field(default_factory=lambda: int(time.time() * 1000))

    def __post_init__(self):
        self.held: list[DataFrame] = []
        for p in self.plugins:
            p.initialize(self.config)

    def hold(self, df: DataFrame) -> DataFrame:
        """Cached until close."""
        self.held.append(df.persist())
        return df

    def close(self) -> None:
        """Frees what the run has cached; a later run of the session reads the files anew."""
        while self.held:
            self.held.pop().unpersist()

    @property
    def root(self) -> str:
        return os.path.abspath(self.config["root_dir"])

    @property
    def cache(self) -> str | None:
        return settings.cache_dir(self.config) if self.config["cache"]["enabled"] else None

    def rule(self, kind: str) -> dict:
        return {"enabled": True, "severity": validate.SEVERITY.get(kind, "warning")} | self.config["rules"].get(kind, {})

    @cached_property
    def tree(self) -> DataFrame:
        """Every file and directory, listed once for all that is read."""
        return self.hold(files.tree(self.spark, self.root))

    @cached_property
    def all_documents(self) -> DataFrame:
        return self.given.get("documents") if "documents" in self.given else files.documents(self.spark, self.root, self.config["include"], self.config["exclude"], listed=self.tree)

    @cached_property
    def documents(self) -> DataFrame:
        """Those to check: with an incremental run the new and changed ones."""
        docs = self.all_documents
        if self.config["incremental"]["enabled"] and self.cache:
            docs = state.changed_docs(docs, state_table(self.spark, os.path.join(self.cache, "hashes"), "path string, md5 string"))
        return self.hold(docs.select("path", "format", "content"))

    @cached_property
    def code(self) -> DataFrame:
        if "code" in self.given:
            return self.given["code"]
        return self.hold(files.code_files(self.spark, self.root, self.config["source_patterns"], listed=self.tree).drop("pattern_ord"))

    @cached_property
    def manifests(self) -> DataFrame:
        return self.given.get("manifests") if "manifests" in self.given else files.manifests(self.spark, self.root, self.config["manifest_files"] or [], listed=self.tree)

    @cached_property
    def listing(self) -> DataFrame:
        if "listing" in self.given:
            return self.given["listing"]
        return self.hold(files.listing(self.tree.select("path")))

    @cached_property
    def commits(self) -> DataFrame | None:
        return self.given.get("commits") if "commits" in self.given else (log.commits(self.spark, self.root) if log.current_commit(self.root) else None)

    @cached_property
    def symbols(self) -> DataFrame:
        return self.hold(index.symbols(self.code))

    @cached_property
    def references(self) -> DataFrame:
        """All references; those of disabled rules too, as they are counted as skipped."""
        runs = dict(extract.EXTRACTORS) | {"code-snippet": snippets.snippets}
        for p in self.plugins:
            runs |= p.extractors()
        return self.hold(extract.extract(self.documents, runs))

    def validators(self) -> dict[str, Callable[[DataFrame], DataFrame]]:
        def option(kind: str) -> dict:
            rule = self.rule(kind)
            return {"severity": rule["severity"], "skip_examples": rule.get("skip_illustrative", True) is not False, "custom": tuple(rule.get("illustrative_patterns") or ())}

        only = lambda kind: {"severity": self.rule(kind)["severity"]}
        exports = lambda: index.exports(self.code)
        snippet = self.rule("code-snippet")
        parts = {"import": snippet.get("validate_imports", True), "function-call": snippet.get("validate_function_calls", True), "config-keys": snippet.get("validate_config_keys", True)}
        out = {
            "file-path": lambda r: validate.file_paths(r, self.listing, self.root, **option("file-path")),
            "external-url": lambda r: validate.external_urls(r, self.verdicts(r), self.config["urls"]["enabled"]),
            "version": lambda r: validate.versions(r, manifests.effective_versions(self.manifests), **only("version")),
            "directory-structure": lambda r: validate.directories(r, self.listing, self.root, **option("directory-structure")),
            "code-pattern": lambda r: validate.symbols(r, self.symbols, **only("code-pattern")),
            "dependency": lambda r: validate.packages(r, manifests.dependencies(self.manifests), **only("dependency")),
            "code-snippet": lambda r: validate.snippets(r, self.code, self.listing, exports(), index.signatures(self.code), index.interface_keys(self.code), severity=snippet["severity"], enabled=parts, custom=tuple(snippet.get("illustrative_patterns") or ())),
        }
        for p in self.plugins:
            out |= p.validators()
        return out

    def verdicts(self, refs: DataFrame) -> DataFrame:
        """Verdicts of the distinct URLs; asked are those without a fresh cached one."""
        u, asked = self.config["urls"], refs.select(F.col("value").alias("url"))
        schema = "url string, valid boolean, severity string, message string, status_code int, ts_ms long"
        cache = state_table(self.spark, os.path.join(self.cache, "urls"), schema) if self.cache else None
        probes = self.given.get("probes")
        if probes is None:
            probes = live.probe(validate.to_probe(asked, cache, self.now_ms, u["cache_seconds"]), timeout_ms=u["timeout_ms"], concurrency=u["concurrency"])
        return self.hold(validate.url_verdicts(asked, probes, cache, skip_domains=tuple(u["skip_domains"]), severity=self.rule("external-url")["severity"], now_ms=self.now_ms, cache_seconds=u["cache_seconds"]))

    @cached_property
    def results(self) -> DataFrame:
        run, out = self.validators(), None
        for p in self.plugins:
            p.before(self.documents)
        for kind in dict.fromkeys([*extract.EXTRACTORS, "code-snippet", *run]):
            refs = self.references.where(F.col("type") == kind)
            if kind in run and self.rule(kind)["enabled"] is not False:
                rows = run[kind](refs)
            else:
                null = F.lit(None).cast("string")
                rows = refs.withColumns({"valid": F.lit(True), "skipped": F.lit(True), "severity": null, "message": null, "suggestion": null})
            out = rows.select(RESULT) if out is None else out.unionByName(rows.select(RESULT))
        out = self.hold(out)
        for p in self.plugins:
            p.after(out)
        return out

    @cached_property
    def summary(self) -> dict:
        return score.summary(self.results).first().asDict()

    @property
    def issues(self) -> DataFrame:
        return score.issues(self.results)

    @property
    def issues_by_doc(self) -> DataFrame:
        return score.issues_by_doc(self.results)

    @cached_property
    def edges(self) -> DataFrame:
        return self.hold(graph.edges(self.references, self.symbols, self.root))

    @cached_property
    def scores(self) -> DataFrame | None:
        if not (self.config["scoring"]["enabled"] and self.config["graph"]["enabled"]):
            return None
        pairs, docs, s = graph.pairs(self.edges), self.documents, self.config["scoring"]
        parts = [score.validity(docs, self.results), score.time_delta(docs, pairs, self.commits), score.churn(docs, pairs, self.commits), score.coverage(docs, self.references, pairs, graph.code_symbols(self.symbols))]
        return self.hold(score.doc_scores(docs, parts, s["weights"], s["thresholds"]))

    @cached_property
    def project(self) -> dict:
        return score.project_score(self.scores, self.config["scoring"]["thresholds"]).first().asDict()

    @cached_property
    def code_by_doc(self) -> DataFrame | None:
        return graph.code_for_doc(self.edges) if self.config["graph"]["enabled"] else None

    @cached_property
    def impacted(self) -> DataFrame | None:
        if self.commits is None or not self.config["graph"]["enabled"]:
            return None
        since = F.timestamp_millis(F.lit(self.now_ms - self.config["change_window_days"] * 86_400_000))
        return graph.affected_docs(self.edges, history.changed_since(self.commits, since))

    def texts(self) -> tuple[DataFrame, DataFrame]:
        """Sections and comments that are compared, with the key of each text in the cache of embeddings."""
        keyed = lambda df, kind: df.withColumns({"kind": F.lit(kind), "key": F.concat(F.lit(f"{kind}:"), F.md5(F.col("text").cast("binary")))})
        sections = extract.sections(self.documents).where(F.char_length("text") >= semantic.LEAST_SECTION).withColumn("doc_id", F.concat_ws("#", "path", F.col("ord").cast("string")))
        comments = index.comments(self.code).where(F.char_length("text") >= semantic.LEAST_COMMENT).withColumn("code_id", F.concat_ws("#", "path", "kind", F.col("start").cast("string")))
        return keyed(sections, "doc"), keyed(comments.drop("kind"), "code")

    @cached_property
    def embeddings(self) -> DataFrame:
        """key, embedding, ts_ms: those of earlier runs, and of the texts that they lack; only these go to the model."""
        known = state_table(self.spark, os.path.join(self.cache, "embeddings"), EMBEDDINGS) if self.cache else self.spark.createDataFrame([], EMBEDDINGS)
        sections, comments = self.texts()
        missing = state.missing_embeddings(sections.select("kind", "text").unionByName(comments.select("kind", "text")), known)
        return self.hold(known.unionByName(semantic.embed(missing, self.model).select("key", "embedding", F.lit(self.now_ms).alias("ts_ms"))))

    @cached_property
    def mismatches(self) -> DataFrame | None:
        """Sections unlike any comment; None without a model."""
        if not self.config["semantic"]["enabled"] or self.model is None:
            return None
        sections, comments = self.texts()
        vectors = [d.select(k, "key").join(self.embeddings.select("key", "embedding"), "key").select(k, "embedding") for d, k in ((sections, "doc_id"), (comments, "code_id"))]
        return semantic.mismatches(sections.drop("kind", "key"), semantic.best_matches(*vectors), self.config["semantic"]["similarity_threshold"])

    def saved_graph(self) -> DataFrame | None:
        """The edges that the last run saved, if they still hold for this configuration and commit; else None."""
        if not self.cache or not os.path.isdir(os.path.join(self.cache, "edges")):
            return None
        meta = state_table(self.spark, os.path.join(self.cache, "graph"), "build_ts_ms long, config_hash string, git_commit string")
        valid = state.graph_is_valid(meta, self.config_hash(), log.current_commit(self.root), self.now_ms, self.config["graph"].get("max_age_ms", 86_400_000)).first()
        return state_table(self.spark, os.path.join(self.cache, "edges"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.edges.schema)) if valid and valid["valid"] else None

    def config_hash(self) -> str:
        kept = {k: self.config.get(k) for k in ("include", "exclude", "source_patterns", "manifest_files")}
        return hashlib.md5(json.dumps(kept).encode()).hexdigest()

    def save_state(self) -> None:
        """Hashes of the documents seen, the graph, and the URL verdicts of this run before older ones."""
        if not self.cache:
            return
        os.makedirs(self.cache, exist_ok=True)
        if self.mismatches is not None:
            replace_table(state.keep_newest(self.embeddings, "key", "ts_ms", MOST_EMBEDDINGS), os.path.join(self.cache, "embeddings"), self.now_ms)
        if self.config["incremental"]["enabled"]:
            replace_table(state.new_state(self.all_documents), os.path.join(self.cache, "hashes"), self.now_ms)
        if not self.config["graph"]["enabled"]:
            return
        replace_table(self.edges, os.path.join(self.cache, "edges"), self.now_ms)
        meta = [(self.now_ms, self.config_hash(), log.current_commit(self.root))]
        replace_table(self.spark.createDataFrame(meta, "build_ts_ms long, config_hash string, git_commit string"), os.path.join(self.cache, "graph"), self.now_ms)
        refs = self.references.where("type = 'external-url'")
        if self.config["urls"]["enabled"]:
            path = os.path.join(self.cache, "urls")
            schema = "url string, valid boolean, severity string, message string, status_code int, ts_ms long"
            fresh = self.verdicts(refs).where("not skipped").select("url", "valid", "severity", "message", "status_code", F.lit(self.now_ms).alias("ts_ms"))
            replace_table(state.keep_newest(state_table(self.spark, path, schema).unionByName(fresh), "url", "ts_ms", self.config["urls"]["max_cache"]), path, self.now_ms)

    def report(self) -> dict[str, str]:
        """The text of each reporter; written to the output path where one is set."""
        reporters = dict(report.REPORTERS)
        for p in self.plugins:
            reporters |= p.reporters()
        out = {name: reporters[name](self) for name in self.config["reporters"]}
        for name, text in out.items():
            if self.config.get("output_path") and name != "console":
                report.write(self.config["output_path"], text)
        return out


def run(spark: SparkSession, config: dict, **given) -> Check:
    """Checks, saves state and gives the finished run."""
    check = Check(spark, config, **given)
    if config["clear_cache"]:
        shutil.rmtree(settings.cache_dir(config), ignore_errors=True)
    check.summary
    check.save_state()
    return check
