"""Output formats: one row of text per file, in order; and property-graph exports.

A formatter returns (ord, text) rows, so ``write.text`` makes the output in
parallel; nothing is joined into one string on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import code_fence, escape_cell, escape_xml, escape_yaml, lines


def _cdata(text: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def as_xml(path: Column, language: Column, content: Column) -> Column:
    lang = F.when(language.isNotNull(), F.concat(F.lit(' language="'), escape_xml(language), F.lit('"'))).otherwise("")
    return F.concat(F.lit('<file path="'), escape_xml(path), F.lit('"'), lang, F.lit(">"), _cdata(F.coalesce(content, F.lit(""))), F.lit("</file>"))


def as_markdown(path: Column, language: Column, content: Column) -> Column:
    body = F.coalesce(content, F.lit(""))
    fence = code_fence(body)
    return F.concat(F.lit("### "), escape_cell(path), F.lit("\n\n"), fence, F.coalesce(language, F.lit("")), F.lit("\n"), body, F.lit("\n"), fence)


def as_yaml(path: Column, language: Column, content: Column) -> Column:
    quoted = lambda c: F.concat(F.lit('"'), escape_yaml(F.coalesce(c, F.lit(""))), F.lit('"'))
    return F.concat(F.lit("- path: "), quoted(path), F.lit("\n  language: "), quoted(language), F.lit("\n  content: "), quoted(content))


def as_toon(path: Column, language: Column, content: Column) -> Column:
    """One tabular line: path, language, content, commas and line ends escaped."""
    cell = lambda c: F.replace(escape_yaml(F.coalesce(c, F.lit(""))), F.lit(","), F.lit("\\,"))
    return F.concat_ws(",", cell(path), cell(language), cell(content))


def as_plain(path: Column, language: Column, content: Column) -> Column:
    """Numbered lines under the path."""
    numbered = F.transform(lines(F.coalesce(content, F.lit(""))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    return F.concat(F.lit("=== "), path, F.lit(" ===\n"), F.array_join(numbered, "\n"))


def as_json(path: Column, language: Column, content: Column) -> Column:
    return F.to_json(F.struct(path.alias("path"), language.alias("language"), content.alias("content")))


FORMATS = {"xml": as_xml, "markdown": as_markdown, "yaml": as_yaml, "toon": as_toon, "plain": as_plain, "json": as_json}


def emit(files: DataFrame, form: str, order: str = "ord") -> DataFrame:
    """(order, text) of files (order, path, language, content) in a format."""
    return files.select(order, FORMATS[form](F.col("path"), F.col("language"), F.col("content")).alias("text"))


def emit_document(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): a document's blocks in order, as Markdown. Documents are bounded; their blocks are joined as one value."""
    text = F.when(F.col("block_type") == "heading", F.concat(F.lit("## "), F.col("text"))).when(
        F.col("block_type") == "code", F.concat(code_fence(F.col("text")), F.lit("\n"), F.col("text"), F.lit("\n"), code_fence(F.col("text")))
    )
    rows = blocks.select(key, "block_ord", F.coalesce(text, F.col("text")).alias("t"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "t"))), lambda b: b["t"])
    return rows.groupBy(key).agg(F.array_join(joined, "\n\n").alias("text"))


def chunk_header(chunk: Column, total: Column, focus: Column) -> Column:
    return F.format_string("# Chunk %s of %s: %s", (chunk + 1).cast("string"), total.cast("string"), focus)


def graph_export(symbols: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, label, name) and edges (id, src, dst, label) of symbols (symbol_id, name, file, parent_id) and calls (src, dst)."""
    symbol = symbols.select(F.concat(F.lit("s:"), "symbol_id").alias("id"), F.lit("symbol").alias("label"), "name")
    file = symbols.select("file").distinct().select(F.concat(F.lit("f:"), "file").alias("id"), F.lit("file").alias("label"), F.col("file").alias("name"))
    module = F.regexp_extract("file", r"^([^/]*)", 1)
    modules = symbols.select(module.alias("m")).distinct().select(F.concat(F.lit("m:"), "m").alias("id"), F.lit("module").alias("label"), F.col("m").alias("name"))
    made = [
        symbols.select(F.concat(F.lit("s:"), "symbol_id").alias("src"), F.concat(F.lit("f:"), "file").alias("dst"), F.lit("DEFINED_IN").alias("label")),
        calls.select(F.concat(F.lit("s:"), "src").alias("src"), F.concat(F.lit("s:"), "dst").alias("dst"), F.lit("CALLS").alias("label")),
        symbols.select(F.concat(F.lit("f:"), "file").alias("src"), F.concat(F.lit("m:"), module).alias("dst"), F.lit("BELONGS_TO").alias("label")).distinct(),
        symbols.filter("parent_id IS NOT NULL").select(
            F.concat(F.lit("s:"), "parent_id").alias("src"), F.concat(F.lit("s:"), "symbol_id").alias("dst"), F.lit("CONTAINS").alias("label")
        ),
    ]
    edges = made[0]
    for more in made[1:]:
        edges = edges.unionByName(more)
    identity = F.concat_ws("-", "src", "label", "dst").alias("id")
    return symbol.unionByName(file).unionByName(modules), edges.select(identity, "src", "dst", "label")


def pgvector_schema(table: str, dims: int = 1536) -> str:
    """SQL that makes a table for chunks with vectors of ``dims`` numbers (2 to 16,000)."""
    if not 2 <= dims <= 16_000:
        raise ValueError("dims must be between 2 and 16000")
    if not table.replace("_", "").isalnum() or table[0].isdigit():
        raise ValueError(f"not a table name: {table!r}")
    return (
        "CREATE EXTENSION IF NOT EXISTS vector;\n"
        f"CREATE TABLE IF NOT EXISTS {table} (\n  id TEXT PRIMARY KEY,\n  full_hash TEXT NOT NULL,\n  content TEXT NOT NULL,\n"
        f"  tokens INTEGER NOT NULL,\n  kind TEXT NOT NULL,\n  metadata JSONB NOT NULL,\n  embedding vector({dims})\n);\n"
        f"CREATE INDEX IF NOT EXISTS {table}_embedding ON {table} USING hnsw (embedding vector_cosine_ops);\n"
    )
