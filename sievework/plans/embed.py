"""Embed chunks: content-addressed pieces of code with what retrieval needs, and their difference to a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.functions.tokens import estimate
from sievework.operators import chunking, context, detect, state
from sievework.sources import code


def chunks(files: DataFrame, repo: str = "repo", limit: int = 1000, redact: bool = True) -> DataFrame:
    """Chunks of files (path, language, content): symbols, long ones in parts, with ids, keys, tags, keywords and tokens."""
    if redact:
        files = files.withColumn("content", detect.redact_secrets_udf()("content"))
    symbols = code.parse_symbols(files).filter("kind != 'import'")
    own = symbols.join(files.select(F.col("path").alias("file"), "content"), "file")
    body = F.array_join(F.slice(X.lines(F.col("content")), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    rows = own.withColumn("text", X.normalize_lines(body)).filter("text != ''").drop("content")
    key = X.location_key(F.lit(repo), F.col("file"), F.col("kind"), F.col("parent"), F.col("name"), F.col("start_line"))
    rows = rows.withColumn("symbol_key", key)
    parts = chunking.split_long(rows, "symbol_key", "text", limit).withColumnRenamed("text", "content")
    made = rows.drop("text").join(parts, "symbol_key")
    words = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(r"[A-Za-z_]\w*"), F.lit(0)), X.split_identifier))
    made = made.withColumn("full_hash", X.content_hash(F.col("content"))).withColumn("location_key", X.location_key(F.col("symbol_key"), F.col("part")))
    return made.select(
        X.chunk_id(F.col("location_key"), F.col("full_hash")).alias("id"), "full_hash", "location_key", "file", "name", "kind", "parent", "part", "content",
        estimate(F.col("content"), "claude").alias("tokens"), context.tags_of(F.col("name"), F.col("signature"), F.col("kind")).alias("tags"),
        F.array_distinct(F.transform(words, lambda w: F.lower(w))).alias("words"), "calls", "signature", X.first_sentence(F.coalesce("docstring", F.lit(""))).alias("summary"),
    )


def difference(made: DataFrame, manifest: DataFrame) -> DataFrame:
    """(location_key, status) against a saved manifest; ids that stand for two contents are an error."""
    if not state.collisions(made, "id").isEmpty():
        raise ValueError("chunk ids collide")
    return state.manifest_diff(made.select("location_key", "full_hash"), manifest)


def batch(files: DataFrame, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(chunks, failures) of several repositories' files (repo, path, language, content): a repository whose files can't be read is a failure, the others go on.

    Chunks have the column ``repo`` and keys within it; failures are (repo, error).
    """
    bad = files.filter("path IS NULL OR content IS NULL").groupBy("repo").agg(F.format_string("%d files without a path or content", F.count("*")).alias("error"))
    good = files.join(bad.select("repo"), "repo", "left_anti")
    named = good.withColumn("path", F.concat_ws("\u0001", "repo", "path"))
    made = chunks(named, "", limit)
    own = F.split("file", "\u0001")
    return made.withColumn("repo", own[0]).withColumn("file", own[1]), bad
