"""Distillation of documents: strip, deduplicate, compress, score, arrange.

Blocks are rows (doc_id, block_ord, block_type, text); stages are functions
from DataFrame to DataFrame, so levels are compositions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.tables import (
    BOILERPLATE,
    FILLERS,
    INFORMATIVE_WORDS,
    LOWERING_TITLES,
    RAISING_TITLES,
    REQUIREMENT_WORDS,
)
from sievework.functions.text import contains_any, count_contained, lines, normalize_for_dedup, trim


def line_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, block_ord, block_type, text): each line a paragraph."""
    own = F.posexplode(lines(F.coalesce(F.col(text), F.lit("")))).alias("block_ord", "text")
    return docs.select(F.col(key).alias("doc_id"), own).select("doc_id", "block_ord", F.lit("paragraph").alias("block_type"), "text")


def is_page_number(text: Column) -> Column:
    """For a trimmed lower-case text: dashed numbers, ``page ...``, ``n / m``; a lone slash counts."""
    bare = F.regexp_replace(text, r"^[-– —]+|[-– —]+$", "")
    dashed = (bare != text) & bare.rlike(r"^[0-9]{1,4}$")
    return dashed | text.startswith("page ") | text.rlike(r"^\s*[0-9]*\s*/\s*[0-9]*\s*$")


def is_worthless(text: Column) -> Column:
    """Blank, a page number, under five bytes without a letter, or boilerplate."""
    lower = F.lower(text)
    own = trim(lower)
    tiny = (F.octet_length(own) < 5) & ~own.rlike(r"\p{L}")
    return (own == "") | is_page_number(own) | tiny | contains_any(lower, BOILERPLATE)


def strip(blocks: DataFrame) -> DataFrame:
    """Stage 1: paragraphs and raw blocks that are worthless go."""
    plain = F.col("block_type").isin("paragraph", "raw")
    return blocks.filter(~(plain & is_worthless(F.col("text"))))


def mark_repeats(blocks: DataFrame) -> DataFrame:
    """``kept``: not a paragraph whose normalised text, of 20 bytes or more, stands earlier in the document."""
    rows = blocks.withColumn("__norm", normalize_for_dedup(F.col("text")))
    long = (F.col("block_type") == "paragraph") & (F.octet_length("__norm") >= 20)
    rows = rows.withColumn("__norm", F.when(long, F.col("__norm")))
    first = Window.partitionBy("doc_id", F.coalesce("__norm", F.concat(F.lit("\0"), F.col("block_ord").cast("string")))).orderBy("block_ord")
    return rows.withColumn("kept", F.row_number().over(first) == 1).drop("__norm")


def deduplicate(blocks: DataFrame) -> DataFrame:
    """Stage 2: repeats go."""
    return mark_repeats(blocks).filter("kept").drop("kept")


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def _compress(text: str) -> str:
    lower = _ascii_lower(text)
    for phrase, replacement in FILLERS:
        at = lower.find(phrase)
        while at >= 0:
            end = at + len(phrase)
            new, rest = replacement, text[end:]
            if not replacement:
                k = next((i for i, c in enumerate(rest) if c.isalpha()), None)
                rest = rest if k is None else rest[:k] + rest[k].upper() + rest[k + 1 :]
            elif at == 0 or text[:at].endswith((". ", ".\n")):
                new = replacement[0].upper() + replacement[1:]
            text = text[:at] + new + rest
            lower = _ascii_lower(text)
            at = lower.find(phrase)
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip()


def compress_udf() -> object:
    """Stage 3 as a pandas UDF: filler phrases in their order, with the capitals that removal asks for."""

    @F.pandas_udf("string")
    def compressed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: t if t is None else _compress(t))

    return compressed


def compress(blocks: DataFrame) -> DataFrame:
    """Stage 3: filler phrases of paragraphs go or become short."""
    plain = F.col("block_type").isin("paragraph", "blockquote", "raw")
    done = compress_udf()(F.when(plain, F.col("text")))
    return blocks.withColumn("text", F.when(plain, done).otherwise(F.col("text")))


def paragraph_score(text: Column) -> Column:
    """0 to 1: more for normative words and data, less for informative words and short texts."""
    lower = F.lower(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    number = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)$"
    digits = lambda w: F.octet_length(F.regexp_replace(w, "[^0-9]", ""))
    data = F.filter(
        words,
        lambda w: F.contains(w, F.lit("%")) | w.rlike(number) | (F.contains(w, F.lit("/")) & (F.octet_length(w) <= 10) & (digits(w) >= 2)),
    )
    density = F.size(data) / F.greatest(F.size(words), F.lit(1))
    score = (
        F.lit(0.5)
        + count_contained(lower, REQUIREMENT_WORDS) * 0.15
        - count_contained(lower, INFORMATIVE_WORDS) * 0.05
        + density * 0.3
        - F.when(F.octet_length(text) < 50, 0.15).otherwise(0.0)
        + F.when(F.octet_length(text) > 300, 0.05).otherwise(0.0)
    )
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def block_score(kind: Column, text: Column) -> Column:
    own = paragraph_score(text)
    return (
        F.when(kind == "table", 0.9)
        .when(kind == "definition", 0.85)
        .when(kind == "code", 0.7)
        .when(kind == "list", F.when(contains_any(F.lower(text), REQUIREMENT_WORDS), 0.85).otherwise(0.6))
        .when(kind == "paragraph", own)
        .when(kind == "blockquote", own + 0.1)
        .when(kind == "cross_reference", 0.5)
        .otherwise(0.2)
    )


def title_adjustment(title: Column) -> Column:
    lower = F.lower(F.coalesce(title, F.lit("")))
    raised = [F.when(contains_any(lower, words), 0.2).otherwise(0.0) for words in RAISING_TITLES]
    return raised[0] + raised[1] - F.when(contains_any(lower, LOWERING_TITLES), 0.15).otherwise(0.0)


def score_sections(blocks: DataFrame, keys: list[str] = ("doc_id",), title: str | None = None) -> DataFrame:
    """Stage 4: (keys, importance): the mean of block scores, moved by the title, within 0 and 1."""
    extra = [F.max(title).alias("__title")] if title else []
    mean = blocks.groupBy(*keys).agg(F.avg(block_score(F.col("block_type"), F.col("text"))).alias("__mean"), *extra)
    moved = F.coalesce("__mean", F.lit(0.3)) + (title_adjustment(F.col("__title")) if title else F.lit(0.0))
    return mean.select(*keys, F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0)).alias("importance"))


def arrange(sections: DataFrame, key: str = "doc_id", ord: str = "ord", score: str = "importance") -> DataFrame:
    """Stage 5: ``sections`` with new_ord: the best third first, the next third last, the rest between; fewer than three stay."""
    by_score = Window.partitionBy(key).orderBy(F.desc(score), ord)
    all_rows = Window.partitionBy(key)
    rows = sections.withColumn("__r", F.row_number().over(by_score)).withColumn("__n", F.count("*").over(all_rows))
    third = F.ceil(F.col("__n") / 3)
    part = F.when(F.col("__n") < 3, 0).when(F.col("__r") <= third, 0).when(F.col("__r") <= 2 * third, 2).otherwise(1)
    rows = rows.withColumn("__part", part)
    return rows.withColumn("new_ord", F.row_number().over(Window.partitionBy(key).orderBy("__part", ord))).drop("__r", "__n", "__part")


LEVELS = ("none", "minimal", "balanced", "aggressive", "full")


def distill(blocks: DataFrame, level: str = "full") -> DataFrame:
    """Blocks after the stages of a level; for ``full`` with ``importance`` and ``new_ord`` of each block as a section."""
    depth = LEVELS.index(level)
    for stage in (strip, deduplicate, compress)[:depth]:
        blocks = stage(blocks)
    if depth < 4:
        return blocks
    scored = blocks.withColumn("importance", block_score(F.col("block_type"), F.col("text")))
    return arrange(scored, "doc_id", "block_ord", "importance")
