"""The flagship plan: documents to distilled, redacted, chunked text; and packing of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.tokens import estimate
from sievework.operators import corpus, detect, distill, rank


def ingest(docs: DataFrame, level: str = "full", max_tokens: int = 4000, redact: bool = True) -> DataFrame:
    """(doc_id, ord, tokens, block_ord, text, chunk): distilled, redacted blocks of documents (doc_id, text), in chunks."""
    blocks = distill.distill(distill.line_blocks(docs), level)
    order = "new_ord" if level == "full" else "block_ord"
    if redact:
        blocks = blocks.withColumn("text", detect.redact_pii_udf()("text"))
    sized = blocks.withColumn("tokens", estimate(F.col("text"), "claude").cast("long")).withColumn("ord", F.col(order).cast("long"))
    return corpus.pack_chunks(sized, ["doc_id"], ["ord"], "tokens", max_tokens, "ord", ["block_ord", "text"])


def summary(docs: DataFrame, level: str = "balanced") -> DataFrame:
    """Per language: documents, blocks before and after, tokens before and after distillation."""
    blocks = distill.line_blocks(docs)
    before = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks_before"), F.sum(estimate(F.col("text"), "claude")).alias("tokens_before"))
    after = distill.distill(blocks, level).groupBy("doc_id").agg(F.count("*").alias("blocks_after"), F.sum(estimate(F.col("text"), "claude")).alias("tokens_after"))
    rows = docs.select("doc_id", "lang").join(before, "doc_id", "left").join(after, "doc_id", "left")
    zero = F.lit(0).cast("long")
    names = ("blocks_before", "blocks_after", "tokens_before", "tokens_after")
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), *[F.sum(F.coalesce(n, zero)).alias(n) for n in names])


def pack(files: DataFrame, budget: int, model: str = "claude", include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(path, importance, tokens, action, used): files (path, content) by importance within a budget, paths filtered first."""
    kept = corpus.filter_paths(files, list(include), list(exclude))
    sized = kept.withColumn("importance", rank.file_importance(F.col("path"), F.lit(0))).withColumn("tokens", estimate(F.col("content"), model).cast("long"))
    done = corpus.enforce_budget(sized.withColumn("all", F.lit(1)), ["all"], "importance", "path", "tokens", budget)
    return sized.select("path", "importance", "tokens").join(done.drop("all"), "path")
