"""Corpus-wide statistics, filters and budgets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sievework.functions.tables import COUNTED_MODELS, DEFAULT_IGNORES, DOC_IGNORES, LANGUAGES, TEST_IGNORES
from sievework.functions.text import glob_regex, lines
from sievework.functions.tokens import estimate, estimate_from, scan_estimate, token_stats
from sievework.operators.packing import next_fit, within_budget


def language_stats(files: DataFrame, language: str = "language", text: str = "content", model: str = "claude") -> DataFrame:
    """Files, lines, share of files in percent and tokens per language."""
    per = files.groupBy(F.col(language).alias("language")).agg(
        F.count("*").alias("files"), F.sum(F.size(lines(F.col(text)))).alias("lines"), F.sum(estimate(F.col(text), model)).alias("tokens")
    )
    total = per.agg(F.sum("files").alias("total"))
    return per.crossJoin(F.broadcast(total)).select(  # the right side is one row
        "language", "files", "lines", F.round(100.0 * F.col("files") / F.col("total"), 4).alias("percent"), "tokens"
    )


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, model, tokens) of each document and counted model."""
    pairs = [F.struct(F.lit(m).alias("model"), estimate_from(F.col("stats"), m).alias("tokens")) for m in COUNTED_MODELS]
    rows = docs.select(key, token_stats(F.col(text)).alias("stats")).select(key, F.explode(F.array(*pairs)).alias("m"))
    return rows.select(key, "m.model", "m.tokens")


def cheapest_model(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The model with the fewest tokens; of equal ones the first in the table."""
    options = [
        F.struct(estimate_from(F.col("stats"), m).alias("tokens"), F.lit(i).alias("ord"), F.lit(m).alias("model")) for i, m in enumerate(COUNTED_MODELS)
    ]
    return docs.select(key, token_stats(F.col(text)).alias("stats")).select(key, F.array_min(F.array(*options)).alias("m")).select(key, "m.model", "m.tokens")


def scan_totals(files: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Files, bytes and summed listing estimates of every counted model."""
    return files.agg(
        F.count("*").alias("files"), F.sum(size).alias("bytes"), *[F.sum(scan_estimate(F.col(size), m)).alias(f"tokens_{m}") for m in COUNTED_MODELS]
    )


def language_of(path: Column) -> Column:
    """The language of a path's extension, else null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def is_binary(content: Column) -> Column:
    """More than a tenth of the first 8192 bytes are control characters other than tab, line feed and carriage return."""
    head = F.hex(F.substring(content, 1, 8192))
    control = F.regexp_count(F.regexp_replace(head, "(..)", "$1 "), F.lit("(?:0[0-8BCEF]|1[0-9A-F]) "))
    size = F.least(F.octet_length(content), F.lit(8192))
    return F.coalesce(control * 10 > size, F.lit(False))


def excluded_by(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches: as a glob if it has a star, as a path part, or as a prefix; empty patterns never do."""
    tests = []
    for p in filter(None, patterns):
        test = F.array_contains(F.split(path, "/"), p) | F.startswith(path, F.lit(p))
        tests.append(test | path.rlike(glob_regex(p)) if "*" in p else test)
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def included_by(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches: as a glob if it has a star, else as a substring; empty patterns never do."""
    tests = [path.rlike(glob_regex(p)) if "*" in p else F.contains(path, F.lit(p)) for p in patterns if p]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def filter_paths(files: DataFrame, include: list[str] = (), exclude: list[str] = (), path: str = "path") -> DataFrame:
    """Files that an include pattern matches (no patterns: all) and no exclude pattern does."""
    out = files.filter(included_by(F.col(path), list(include))) if include else files
    return out.filter(~excluded_by(F.col(path), list(exclude))) if exclude else out


def matches_any_glob(path: Column, globs: list[str]) -> Column:
    """Whether a path fits any of the globs: one regular expression."""
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))


def is_ignored(path: Column, tests: bool = True, docs: bool = True) -> Column:
    """Whether a path is left out by default: dependencies, builds, assets and the like; without ``tests`` or ``docs`` these too."""
    globs = DEFAULT_IGNORES + ([] if tests else TEST_IGNORES) + ([] if docs else DOC_IGNORES)
    return matches_any_glob(path, globs)


def gitignored(files: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Files that no rule ignores; ``rules``: folder (of the rule file, empty at the top), ord, pattern.

    As for git: a pattern without a slash but at its end fits at any depth below
    the folder, one with a slash only from the folder on, one with a slash at its
    end only folders; what lies in an ignored folder is ignored; ``!`` takes a
    file back, and of all rules that fit the deepest folder's last counts. The
    rules are few, so they become one column expression.
    """
    own = sorted(rules.collect(), key=lambda r: (r["folder"].count("/") + (r["folder"] != ""), r["ord"]))
    kept = F.lit(True)
    for rule in own:
        pattern = rule["pattern"].rstrip()
        if not pattern or pattern.startswith("#"):
            continue
        back, bare = pattern.startswith("!"), pattern.removeprefix("!").removeprefix("\\")
        body = bare.rstrip("/").removeprefix("/")
        anywhere = "" if "/" in bare.rstrip("/") else "(?:.*/)?"
        steps = re.sub(r"\*+|\?|[^*?]+", lambda m: {"*": "[^/]*", "?": "[^/]"}.get(m[0], ".*" if m[0].startswith("**") else re.escape(m[0])), body)
        steps = steps.replace(".*/", "(?:.*/)?")
        folder = re.escape(rule["folder"].rstrip("/") + "/") if rule["folder"] else ""
        end = "/.*" if bare.endswith("/") else "(?:/.*)?"
        kept = F.when(F.col(path).rlike(f"^{folder}{anywhere}{steps}{end}$"), F.lit(back)).otherwise(kept)
    return files.filter(kept)


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by seeded hash order: the same rows whatever the partitions."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def sample_share(rows: DataFrame, key: str, percent: float, seed: int = 42) -> tuple[DataFrame, float]:
    """About ``percent`` of the rows by seeded hash, and the factor that extrapolates sums to all."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    kept = rows.filter(place < F.lit(int(percent / 100 * (1 << 32))))
    total, some = rows.agg(F.count("*")).first()[0], kept.agg(F.count("*")).first()[0]
    return kept, total / some if some else 0.0


def within_limits(files: DataFrame, max_bytes: int = 10 << 20, max_line: int = 10_000, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``): files within the limits on size and on the longest line, both in bytes."""
    longest = F.array_max(F.transform(F.split(content, "\n"), lambda x: F.octet_length(x)))
    reason = F.when(F.octet_length(content) > max_bytes, "file_size").when(longest > max_line, "line_length")
    judged = files.withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def token_tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """(folder, files, tokens): tokens of the files (path, tokens) below each folder down to a depth."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(depth))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    inside = files.filter(F.contains("path", F.lit("/"))).select(F.explode(folders).alias("folder"), "tokens")
    return inside.groupBy("folder").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"))


def top_n(rows: DataFrame, score: Column, key: str, n: int) -> DataFrame:
    """The ``n`` rows of highest score with their rank; ties by key. A distributed top-k, then ranks over n rows."""
    best = rows.withColumn("score", score).orderBy(F.desc("score"), key).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def keyword_top(docs: DataFrame, key: str, words: Column, n: int = 10, stop: list[str] = ()) -> DataFrame:
    """Each document's ``n`` most frequent words (ties: alphabetic), as (key, words)."""
    counted = docs.select(key, F.explode(words).alias("word")).filter(~F.col("word").isin(list(stop)) if stop else F.lit(True))
    counted = counted.groupBy(key, "word").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= n)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda w: w["word"]).alias("words"))


def fold_in_order(
    rows: DataFrame, group: list[str], order: list[Column], carry: list[str], value: str, start: Callable, step: Callable, out: str
) -> DataFrame:
    """(group, carry, out): ``state, result = step(state, value)`` over each group's rows in order.

    Rows are dealt by group, sorted within partitions and streamed, so a group
    of any size needs the memory of one state; ``out`` is the result's DDL.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = rows.select(*group, *carry).schema
    for field in T._parse_datatype_string(out).fields:
        schema = schema.add(field)
    arrow = to_arrow_schema(schema)
    n = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            results = []
            for *keys, v in zip(*columns[:n], columns[-1], strict=True):
                if now != keys:
                    now, state = keys, start()
                state, result = step(state, v)
                results.append(result)
            made = list(zip(*results, strict=True)) or [[] for _ in range(len(arrow) - len(columns) + 1)]
            all_columns = [*columns[:-1], *made]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(all_columns, arrow, strict=True)], schema=arrow)

    dealt = rows.repartition(*group) if group else rows.coalesce(1)
    ordered = dealt.sortWithinPartitions(*[F.col(g) for g in group], *order)
    return ordered.select(*group, *carry, F.col(value).alias("__value")).mapInArrow(run, schema)


def pack_chunks(
    rows: DataFrame, group: list[str], order: list[str], tokens: str, limit: int, key: str, keep: list[str] = (), split: bool = False
) -> DataFrame:
    """(group, key, tokens, keep, chunk): each group's rows in order, packed next-fit into chunks of ``limit`` tokens; a larger row is alone.

    With ``split`` a group is packed by many tasks, for groups that may be a
    large share of all rows; without, by one, for bounded groups such as documents.
    """
    if split:
        own = [*dict.fromkeys([*group, key, tokens, *keep])]
        needed = rows.select(*dict.fromkeys([*own, *order]))
        return next_fit(needed, group, [F.col(o) for o in order], tokens, limit, own)

    def step(state: tuple, value: int) -> tuple:
        chunk, used = state
        if chunk < 0 or used + value > limit:
            return (chunk + 1, value), (chunk + 1,)
        return (chunk, used + value), (chunk,)

    carry = [*dict.fromkeys([key, tokens, *keep])]
    return fold_in_order(rows, group, [F.col(o) for o in order], carry, tokens, lambda: (-1, 0), step, "chunk long")


def chunk_summary(packed: DataFrame, group: list[str], tokens: str) -> DataFrame:
    """(group, chunk, files, tokens) and the number of chunks of each group."""
    per = packed.groupBy(*group, "chunk").agg(F.count("*").alias("files"), F.sum(tokens).alias("tokens"))
    return per.withColumn("total", F.count("*").over(Window.partitionBy(*group)))


RESERVE, MIN_PARTIAL = 1000, 100


def enforce_budget(rows: DataFrame, group: list[str], importance: str, order: str, tokens: str, budget: int) -> DataFrame:
    """(group, order, action, used): keep what fits, truncate into what is left if over 100, else drop and go on.

    By importance, highest first, ties in input order. A truncated row counts
    as filling what is left.
    """
    room = max(0, budget - RESERVE)
    needed = rows.select(*dict.fromkeys([*group, importance, order, tokens]))
    return within_budget(needed, group, [F.desc(importance), F.col(order)], order, tokens, room, MIN_PARTIAL)


def truncated_to_budget(files: DataFrame, budget: int, model: str = "claude", strategy: str = "line", order: str = "path") -> DataFrame:
    """(order, action, used, content) of files (order, importance, tokens, content): as ``enforce_budget`` decides, truncated contents cut, dropped ones null."""
    from sievework.operators.transform import truncate_content_udf

    decided = enforce_budget(files.withColumn("all", F.lit(1)), ["all"], "importance", order, "tokens", budget).drop("all")
    cut = truncate_content_udf(model, strategy)(F.col("content"), F.col("used"))
    text = F.when(F.col("action") == "keep", F.col("content")).when(F.col("action") == "truncate", cut)
    return files.select(order, "content").join(decided, order).select(order, "action", "used", text.alias("content"))
