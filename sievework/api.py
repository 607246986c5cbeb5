"""One entry for a code base: scans, packs, searches, contexts and chunks of its files.

Every method is a plan over the same DataFrame of files, and returns DataFrames;
nothing is computed before a result is read, but for the rounds of graph
algorithms.
"""

from __future__ import annotations

import asyncio
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.config import Settings
from sievework.functions.tokens import estimate
from sievework.operators import chunking, context, corpus, detect, emit, graph, index, rank, transform
from sievework.plans import embed, repo_map
from sievework.sources import code, scan

#: Ways to cut files into chunks.
STRATEGIES = ("fixed", "file", "module", "symbol", "semantic", "dependency")


class CodeBase:
    """Files (path, language, content) with settings."""

    def __init__(self, files: DataFrame, settings: Settings | None = None) -> None:
        self.settings = settings or Settings()
        kept = corpus.filter_paths(files, list(self.settings.include), list(self.settings.exclude))
        self.files = kept.filter(~corpus.is_ignored(F.col("path"), self.settings.tests, self.settings.docs)).select("path", "language", "content")

    @classmethod
    def below(cls, spark: SparkSession, folder: str, settings: Settings | None = None) -> CodeBase:
        """The text files below a folder."""
        return cls(scan.read_files(spark, folder), settings)

    @cached_property
    def symbols(self) -> DataFrame:
        return self.index["symbols"]

    @cached_property
    def index(self) -> dict[str, DataFrame]:
        return index.build_index(self.files)

    @cached_property
    def calls(self) -> DataFrame:
        return self.index["edges"].filter("edge_type = 'call'")

    @cached_property
    def sized(self) -> DataFrame:
        """Files with tokens and importance."""
        counts = self.index["symbols"].groupBy(F.col("file").alias("path")).agg(F.count("*").alias("symbols"))
        rows = self.files.join(counts, "path", "left")
        importance = rank.file_importance(F.col("path"), F.coalesce("symbols", F.lit(0)).cast("double"))
        return rows.withColumn("importance", importance).withColumn("tokens", estimate(F.col("content"), self.settings.model).cast("long"))

    def tokens(self) -> DataFrame:
        """(path, model, tokens) by every model."""
        return corpus.token_counts(self.files, "path", "content")

    def languages(self) -> DataFrame:
        return corpus.language_stats(self.files)

    def secrets(self) -> DataFrame:
        return detect.secret_findings(self.files, "path", "content", "path")

    def personal_data(self) -> DataFrame:
        return detect.pii_findings(self.files, "path", "content")

    def licenses(self) -> DataFrame:
        return detect.license_files(self.files, "path", "content")

    def pack(self, form: str | None = None, budget: int | None = None) -> DataFrame:
        """(path, text): files by importance within the budget, secrets masked, in a format."""
        done = corpus.truncated_to_budget(self.sized.drop("language"), budget or self.settings.budget, self.settings.model, self.settings.strategy)
        rows = done.filter("content IS NOT NULL").join(self.files.select("path", "language"), "path")
        if self.settings.redact:
            rows = rows.withColumn("content", detect.redact_secrets_udf()("content"))
        return emit.emit(rows.select("path", F.col("path").alias("ord"), "language", "content"), form or self.settings.form).select(F.col("ord").alias("path"), "text")

    def find_symbol(self, name: str) -> DataFrame:
        return index.find_symbol(self.symbols, name)

    def callers(self, name: str) -> DataFrame:
        return index.callers_of(self.symbols, self.calls, name)

    def callees(self, name: str) -> DataFrame:
        return index.callees_of(self.symbols, self.calls, name)

    def references(self, name: str) -> DataFrame:
        return index.references_of(self.symbols, self.index["edges"], name)

    def call_sites(self, name: str) -> DataFrame:
        return index.call_sites(self.files, self.symbols.select("symbol_id", "file", "name"), name)

    def call_graph(self, max_nodes: int = 1000, max_edges: int = 5000) -> DataFrame:
        return graph.limited_call_graph(self.calls.select("src", "dst"), max_nodes, max_edges)

    def transitive_callers(self, name: str, depth: int = 3) -> DataFrame:
        starts = self.symbols.filter(F.col("name") == name).select(F.col("symbol_id").alias("node"))
        return graph.reachable(self.calls.select("src", "dst"), starts, depth, backwards=True)

    def cycles(self) -> DataFrame:
        return index.cycle_paths(self.index["edges"].filter("edge_type = 'import'").select("src", "dst"))

    def exported(self) -> DataFrame:
        return rank.exported_symbols(self.symbols)

    def dead_code(self) -> DataFrame:
        used = code.parse_symbols(self.files).select(F.explode("calls").alias("name"))
        return rank.dead_code(self.symbols.join(self.files.select(F.col("path").alias("file"), "language"), "file"), used)

    def breaking_changes(self, old: CodeBase) -> DataFrame:
        """What breaks users of an older version's public symbols."""
        shape = lambda base: code.parse_symbols(base.files).filter("kind != 'import'").select("name", "file", "signature", "visibility", "extends")
        return rank.breaking_changes(shape(old), shape(self))

    def changed_context(self, changed: DataFrame, depth: int = 3, budget: int | None = None) -> DataFrame:
        """(path, role, relevance, tokens): changed files (path), those that import them and their tests, within the budget."""
        found = index.context_impact(self.index, changed, depth)
        role = F.when(F.col("level") == 0, "changed").when(F.col("is_test"), "test").otherwise("dependent")
        relevance = F.when(F.col("level") == 0, 1.0).when(F.col("level") == 1, 0.7).otherwise(0.4)
        rows = found.join(self.sized.select("path", "tokens"), "path").select("path", role.alias("role"), relevance.alias("relevance"), "tokens")
        return index.context_budget(rows, budget or self.settings.budget)

    def impact(self, changed: DataFrame, depth: int = 3) -> DataFrame:
        return index.context_impact(self.index, changed, depth)

    def chunks(self, strategy: str, limit: int = 8000) -> DataFrame:
        """Chunks of files, or for ``symbol`` of symbols, by a strategy."""
        rows = self.sized.select(F.col("path").alias("ord"), "path", "tokens")
        if strategy == "dependency":
            return chunking.dependency_chunks(rows, self.index["imports"].filter("resolved IS NOT NULL").select("path", "resolved"), limit)
        if strategy == "symbol":
            own = code.parse_symbols(self.files).withColumn("importance", F.lit(0.5))
            return chunking.symbol_chunks(chunking.symbol_snippets(own, self.sized, self.settings.model), limit)
        if strategy == "file":
            return chunking.file_chunks(rows)
        made: dict[str, Callable] = {"fixed": chunking.fixed_chunks, "module": chunking.module_chunks, "semantic": chunking.semantic_chunks}
        return made[strategy](rows, limit)

    def embed(self, repo: str = "repo", limit: int = 1000) -> DataFrame:
        return embed.chunks(self.files, repo, limit, self.settings.redact)

    def map(self, budget: int = 2000) -> dict[str, DataFrame]:
        sizes = self.symbols.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("symbols"))
        return repo_map.repo_map(self.symbols, self.calls.select("src", "dst"), sizes, budget)

    def key_symbols(self, around: int = 0) -> DataFrame:
        return transform.key_symbols(self.files, code.parse_symbols(self.files), around)

    def tests_of(self) -> DataFrame:
        """(path, test) by names."""
        return context.tests_by_name(self.files.filter(~context.is_test_file(F.col("path"))).select("path"), self.files.select("path"))


async def later(function: Callable, *given: object, **named: object) -> object:
    """The result of a function that waits for Spark, without blocking the event loop."""
    return await asyncio.to_thread(function, *given, **named)
