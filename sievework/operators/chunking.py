"""Chunk strategies over files and symbols; context between chunks; splitting of long texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.text import lines
from sievework.functions.tokens import estimate
from sievework.operators.corpus import fold_in_order, pack_chunks
from sievework.operators.graph import topological_levels
from sievework.operators.state import numbered

CONTEXT_LINES = 2


def _all(rows: DataFrame) -> DataFrame:
    return rows.withColumn("corpus", F.lit(0))


def fixed_chunks(files: DataFrame, limit: int) -> DataFrame:
    """(path, tokens, chunk): files (ord, path, tokens) in order, next-fit."""
    return pack_chunks(_all(files), ["corpus"], ["ord"], "tokens", limit, "path", split=True).drop("corpus")


def file_chunks(files: DataFrame) -> DataFrame:
    """Each file a chunk, numbered in order of ``ord``."""
    return numbered(files, ["ord"], "chunk")


def module_of(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def module_chunks(files: DataFrame, limit: int) -> DataFrame:
    """(module, path, tokens, chunk): next-fit by path inside each first path segment; chunks are numbered per module."""
    return pack_chunks(files.withColumn("module", module_of(F.col("path"))), ["module"], ["path"], "tokens", limit, "path", split=True)


def semantic_chunks(files: DataFrame, limit: int) -> DataFrame:
    """(path, tokens, chunk, overlap): by path; a chunk ends when full, or when the module changes and it is over half full.

    The last file of a chunk is carried into the next as overlap if it has at most a tenth of the limit.
    """
    coded = _all(files).withColumn("value", F.struct("tokens", module_of(F.col("path")).alias("module")))

    def step(state: tuple, value: dict) -> tuple:
        chunk, used, last, module = state
        tokens, overlap = value["tokens"], False
        new_module = module is not None and value["module"] != module
        if used and (used + tokens > limit or (new_module and used > limit // 2)):
            chunk += 1
            overlap = last * 10 <= limit
            used = last if overlap else 0
        return (chunk, used + tokens, tokens, value["module"]), (chunk, overlap)

    done = fold_in_order(coded, ["corpus"], [F.col("path")], ["path", "tokens"], "value", lambda: (0, 0, 0, None), step, "chunk long, overlap boolean")
    return done.drop("corpus")


def dependency_chunks(files: DataFrame, imports: DataFrame, limit: int) -> DataFrame:
    """(path, tokens, chunk): dependencies before dependents; files on cycles last. ``imports``: path, resolved.

    A chunk ends when it is full, but not before a file that imports one of its files.
    """
    levels = topological_levels(imports.select(F.col("resolved").alias("src"), F.col("path").alias("dst")))
    own = imports.groupBy("path").agg(F.collect_set("resolved").alias("needs"))
    # merge joins: all sides grow with the input, and stored tables are larger than their files
    placed = files.join(levels.withColumnRenamed("node", "path").hint("merge"), "path", "left").join(own.hint("merge"), "path", "left")
    unknown = F.col("level").isNull() & F.col("needs").isNotNull()  # on or behind a cycle
    placed = placed.withColumn("order", F.struct(unknown.alias("u"), F.coalesce("level", F.lit(0)).alias("l"), "path"))
    coded = _all(placed).withColumn("value", F.struct("path", "tokens", F.coalesce("needs", F.array().cast("array<string>")).alias("needs")))

    def step(state: tuple, value: dict) -> tuple:
        chunk, used, inside = state
        if inside and used + value["tokens"] > limit and not inside.intersection(value["needs"]):
            chunk, used, inside = chunk + 1, 0, set()
        inside.add(value["path"])
        return (chunk, used + value["tokens"], inside), (chunk,)

    return fold_in_order(coded, ["corpus"], [F.col("order")], ["path", "tokens"], "value", lambda: (0, 0, set()), step, "chunk long").drop("corpus")


def symbol_snippets(symbols: DataFrame, files: DataFrame, model: str = "claude") -> DataFrame:
    """(file, name, kind, start_line, text, tokens, importance): each symbol with two lines around it, or its signature."""
    rows = symbols.filter("kind != 'import'").join(files.select(F.col("path").alias("file"), "content", F.col("importance").alias("file_importance")), "file")
    own = lines(F.coalesce("content", F.lit("")))
    start = F.greatest(F.col("start_line") - CONTEXT_LINES, F.lit(1))
    end = F.least(F.greatest("end_line", "start_line") + CONTEXT_LINES, F.size(own))
    head = F.format_string("// %s: %s (lines %s-%s)\n", "kind", "name", start.cast("string"), end.cast("string"))
    body = F.array_join(F.slice(own, start, F.greatest(end - start + 1, F.lit(0))), "\n")
    inside = (F.col("start_line") > 0) & (F.col("start_line") <= F.size(own))
    text = F.when(inside, F.concat(head, body)).when(F.col("signature").isNotNull(), F.concat(F.format_string("// %s: %s\n", "kind", "name"), F.trim("signature")))
    made = rows.withColumn("text", text).filter("text IS NOT NULL")
    score = F.coalesce("importance", F.lit(0.5)) * 0.7 + F.coalesce("file_importance", F.lit(0.5)) * 0.3
    return made.select("file", "name", "kind", "start_line", "text", estimate(F.col("text"), model).cast("long").alias("tokens"), score.alias("importance"))


def symbol_chunks(snippets: DataFrame, limit: int) -> DataFrame:
    """Snippets by importance, then fewer tokens, then place, packed next-fit."""
    keyed = snippets.withColumn("snippet", F.struct((-F.col("importance")).alias("i"), "tokens", "file", "start_line", "name"))
    return pack_chunks(_all(keyed), ["corpus"], ["snippet"], "tokens", limit, "snippet", split=True).select("snippet.file", "snippet.name", "tokens", "chunk")


def with_neighbours(chunks: DataFrame, group: list[str] = ()) -> DataFrame:
    """Chunks (chunk, focus) with total, previous and next summaries, per group.

    Without groups the numbers must be consecutive: the neighbours of one long
    list are found by an equi-join, those of groups by windows.
    """
    before, after = F.concat(F.lit("Previous: "), F.col("__before")), F.concat(F.lit("Next: Chunk "), (F.col("__after") + 1).cast("string"))
    if group:
        order = Window.partitionBy(*group).orderBy("chunk")
        rows = chunks.withColumn("total", F.count("*").over(Window.partitionBy(*group)))
        rows = rows.withColumn("__before", F.lag("focus").over(order)).withColumn("__after", F.lead("chunk").over(order))
    else:
        rows = chunks.crossJoin(F.broadcast(chunks.agg(F.count("*").alias("total"))))  # one row
        rows = rows.join(chunks.select((F.col("chunk") + 1).alias("chunk"), F.col("focus").alias("__before")), "chunk", "left")
        rows = rows.join(chunks.select((F.col("chunk") - 1).alias("chunk"), F.col("chunk").alias("__after")), "chunk", "left")
    return rows.select(*chunks.columns, "total", before.alias("previous"), after.alias("next"))


def cross_references(symbols: DataFrame, placed: DataFrame, most: int = 25) -> DataFrame:
    """(chunk, name, other_chunk, file): calls and parent types that another chunk defines, the first ``most`` by name of each chunk."""
    used = F.concat(F.coalesce("calls", F.array().cast("array<string>")), F.coalesce("implements", F.array().cast("array<string>")), F.array("extends"))
    here = symbols.join(placed.select(F.col("path").alias("file"), "chunk"), "file").select("chunk", F.explode(used).alias("name")).filter("name IS NOT NULL").distinct()
    defined = symbols.select("name", "file").join(placed.select(F.col("path").alias("file"), F.col("chunk").alias("other_chunk")), "file").distinct()
    found = here.join(defined, "name").filter("chunk != other_chunk")
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("chunk").orderBy("name", "other_chunk", "file")))
    return ranked.filter(F.col("k") <= most).select("chunk", "name", "other_chunk", "file")


def split_long(texts: DataFrame, key: str, text: str, limit: int, overlap_lines: int = 2, model: str = "claude") -> DataFrame:
    """(key, part, text): lines packed into parts of ``limit`` tokens, each starting with the last lines before; a longer line is cut."""
    from sievework.operators.transform import prefix_tokens, truncate

    def cut(line: str) -> Iterator[str]:
        while line and prefix_tokens(line.encode(), model)[-1] > limit:
            head = truncate(line, limit, model) or line[:1]
            yield head
            line = line[len(head) :]
        yield line

    def parts(body: str) -> list[str]:
        out, held = [], []
        size = lambda rows: int(prefix_tokens("\n".join(rows).encode() or b" ", model)[-1])
        for line in body.split("\n"):
            for piece in cut(line):
                if held and size([*held, piece]) > limit:
                    out.append("\n".join(held))
                    held = held[-overlap_lines:] if overlap_lines and size([*held[-overlap_lines:], piece]) <= limit else []
                held.append(piece)
        return [*out, "\n".join(held)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, p) for k, t in zip(batch[key], batch[text], strict=True) if t is not None for i, p in enumerate(parts(t))]
            yield pd.DataFrame(rows, columns=[key, "part", text])

    return texts.select(key, text).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, part int, {text} string")
