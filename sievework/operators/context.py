"""Context of changes, type hierarchies, embed chunks: relations between symbols, files and repositories."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sievework.functions.shared import FILES_PER_CORE
from sievework.functions.tables import TEST_DIRECTORIES, TEST_FILE_ENDS
from sievework.functions.text import lines
from sievework.operators.graph import closure, reachable

#: Parts, or their possible parents, of one file and name that meet in one sweep, about.
BLOCK = 50_000
# How changed lines of a kind start.
TYPE_STARTS = ["class ", "struct ", "enum ", "interface ", "type ", "trait "]
SIGNATURE_STARTS = ["fn ", "def ", "function ", "func ", "pub fn ", "async fn ", *TYPE_STARTS]
IMPORT_STARTS = ["import ", "from ", "require(", "use ", "#include"]
DOC_STARTS = ["///", "//!", "/**", "/*", "#", '"""', "'''"]
# Weight of a change's class.
CHANGE_WEIGHTS = {
    "deletion": 1.5, "signature": 1.3, "type_definition": 1.2, "file_rename": 1.1, "import": 0.9, "new_code": 0.8, "implementation": 0.7,
    "documentation": 0.3,
}
# Names of test files.
TEST_NAMES = ["test_", "_test.", ".test.", "tests/", "spec/", ".spec.", "__tests__"]


def _starts(line: Column, starts: list[str]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | line.startswith(s)
    return out


def classify_change(change: Column, diff: Column, kind: Column) -> Column:
    """The class of a change from its type, its diff's lines and the symbol's kind."""
    own = lines(F.coalesce(diff, F.lit("")))
    bare = F.transform(own, lambda x: F.regexp_replace(x, r"^[-+ ]+", ""))
    any_line = lambda starts: F.exists(bare, lambda x: _starts(x, starts))
    marked = F.filter(own, lambda x: x.rlike("^[-+].") )
    inner = F.transform(marked, lambda x: F.trim(F.substr(x, F.lit(2))))
    only_docs = F.forall(inner, lambda x: (x == "") | _starts(x, DOC_STARTS))
    return (
        F.when(change == "deleted", "deletion")
        .when(change == "renamed", "file_rename")
        .when(change == "added", "new_code")
        .when(diff.isNotNull() & any_line(TYPE_STARTS), "type_definition")
        .when(diff.isNotNull() & any_line(SIGNATURE_STARTS), "signature")
        .when(diff.isNotNull() & any_line(IMPORT_STARTS), "import")
        .when(diff.isNotNull() & only_docs, "documentation")
        .when(kind.isin("class", "struct", "enum", "interface", "trait", "type"), "type_definition")
        .otherwise("implementation")
    )


def change_weight(change_class: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CHANGE_WEIGHTS.items() for x in pair]), change_class)


def is_test_file(path: Column) -> Column:
    """The wide definition: a path that speaks of tests or specs."""
    lower = F.lower(path)
    return F.contains(lower, F.lit("test")) | F.contains(lower, F.lit("spec"))


def is_named_as_test(path: Column) -> Column:
    """The narrow definition: by the usual file names."""
    lower, out = F.lower(path), F.lit(False)
    for name in TEST_NAMES:
        out = out | F.contains(lower, F.lit(name))
    return out


def is_streamed_test(path: Column) -> Column:
    """The definition for streams: a file below a folder of tests."""
    lower = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    return reduce(lambda a, b: a | b, [F.contains(lower, F.lit(d)) for d in TEST_DIRECTORIES])


def is_chunked_test(path: Column) -> Column:
    """The definition for chunks: below a folder of tests or specs, or with a test's file name."""
    name = F.regexp_extract(F.lower(path), r"([^/\\]*)$", 1)
    named = reduce(lambda a, b: a | b, [name.endswith(e) for e in TEST_FILE_ENDS], name.startswith("test_"))
    return is_streamed_test(path) | F.contains(F.replace(F.lower(path), F.lit("\\"), F.lit("/")), F.lit("/spec/")) | named


def changed_symbols(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id) of symbols (file, start_line, end_line) that overlap changed ranges (file, start, end)."""
    hit = symbols.join(ranges, "file").filter((F.col("start_line") <= F.col("end")) & (F.col("end_line") >= F.col("start")))
    return hit.select("symbol_id").distinct()


def expand_context(changed: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int = 3) -> DataFrame:
    """(symbol_id, level, is_test, score): changed symbols (1.0), their direct users (0.7), and transitive ones (0.4), tests marked.

    ``edges`` (src uses dst) over symbol ids; ``symbols``: symbol_id, file.
    """
    starts = changed.select(F.col("symbol_id").alias("node"))
    found = reachable(edges, starts, depth, backwards=True).unionByName(starts.distinct().withColumn("depth", F.lit(0)))
    score = F.when(F.col("depth") == 0, 1.0).when(F.col("depth") == 1, 0.7).otherwise(0.4)
    rows = found.withColumnRenamed("node", "symbol_id").join(symbols.select("symbol_id", "file"), "symbol_id")
    return rows.select("symbol_id", F.col("depth").alias("level"), is_test_file(F.col("file")).alias("is_test"), score.alias("score"))


def ancestors(types: DataFrame) -> DataFrame:
    """(name, ancestor, depth) of types (name, parent); each ancestor at its least depth."""
    found = closure(types.filter("parent IS NOT NULL").select(F.col("name").alias("src"), F.col("parent").alias("dst")))
    return found.filter("src != dst").select(F.col("src").alias("name"), F.col("dst").alias("ancestor"), "depth")


def descendants(types: DataFrame) -> DataFrame:
    return ancestors(types).select(F.col("ancestor").alias("name"), F.col("name").alias("descendant"), "depth")


def hierarchy_depth(types: DataFrame) -> DataFrame:
    """(name, depth): the largest depth of an ancestor, 0 without any."""
    deep = ancestors(types).groupBy("name").agg(F.max("depth").alias("d"))
    return types.select("name").distinct().join(deep, "name", "left").select("name", F.coalesce("d", F.lit(0)).alias("depth"))


def common_ancestor(types: DataFrame, first: str, second: str) -> DataFrame:
    """One row at most: the second type's nearest ancestor, or itself, that is the first's ancestor or itself."""
    all_up = ancestors(types).unionByName(types.select("name").distinct().select("name", F.col("name").alias("ancestor"), F.lit(0).alias("depth")))
    ours = all_up.filter(F.col("name") == first).select("ancestor")
    return all_up.filter(F.col("name") == second).join(ours, "ancestor").orderBy("depth", "ancestor").limit(1).select("ancestor", "depth")


def hierarchy_summaries(symbols: DataFrame, least: int = 2) -> DataFrame:
    """(file, parent, children, summary) of containers with at least ``least`` members, members in order of their lines."""
    member = F.struct("start_line", F.concat_ws(" ", "kind", F.coalesce("signature", "name")).alias("text"))
    rows = symbols.filter("parent IS NOT NULL").groupBy("file", "parent").agg(F.count("*").alias("children"), F.array_sort(F.collect_list(member)).alias("m"))
    text = F.concat(F.col("parent"), F.lit(":\n"), F.array_join(F.transform("m", lambda m: F.concat(F.lit("- "), m["text"])), "\n"))
    return rows.filter(F.col("children") >= least).select("file", "parent", "children", text.alias("summary"))


def _two_least(first: int, second: int, new: int, ids: list) -> tuple[int, int]:
    """The two least places of three whose ids differ."""
    if new < first:
        return new, (second if ids[new] == ids[first] else first)
    return first, (new if new < second and ids[new] != ids[first] else second)


def _best_owners(owners: list[tuple], children: list[tuple]) -> Iterator[tuple]:
    """(id, t, n, ps, pe, parent_id) of each child (id, start, end) that has one among the owners (id, start, end), which have one file and name.

    A sweep by start: both a containing and an overlapping owner starts at or
    before some line and ends at or after another, so each is the least in a
    prefix of a binary indexed tree over the ends of the owners met so far.
    Two of different ids are kept everywhere, as one may be the child itself.
    """
    none = len(owners)
    rows = [(None if e is None or s is None else e - s, s, e, i) for i, s, e in owners]
    rows.sort(key=lambda r: (*[(v is not None, 0 if v is None else v) for v in r[:3]], r[3]))  # nulls first, as in a minimum of structs
    ids = [*[r[3] for r in rows], None]
    ends = sorted({-r[2] for r in rows if r[0] is not None})
    met = sorted((r[1], k) for k, r in enumerate(rows) if r[0] is not None)
    asked = sorted((x, y, tier, c) for c, (_, s, e) in enumerate(children) if s is not None and e is not None for tier, x, y in ((0, s, e), (1, e, s)))
    tree = [(none, none)] * (len(ends) + 1)
    found: list[list] = [[None, None] for _ in children]
    at = 0
    for x, y, tier, c in asked:
        while at < len(met) and met[at][0] <= x:
            k = met[at][1]
            place = bisect_left(ends, -rows[k][2]) + 1
            while place < len(tree):
                now = tree[place]
                tree[place] = new = _two_least(*now, k, ids)
                if new == now:  # those above hold all of its rows
                    break
                place += place & -place
            at += 1
        place, best = bisect_right(ends, -y), (none, none)
        while place:
            for k in tree[place]:
                best = _two_least(*best, k, ids) if k < none else best
            place -= place & -place
        found[c][tier] = best
    least = (none, none)
    for k in range(none):
        least = _two_least(*least, k, ids)
        if least[1] < none:
            break
    for (own, _, _), tiers in zip(children, found, strict=True):
        for tier, best in enumerate((*tiers, least)):
            k = next((k for k in best or () if k < none and ids[k] != own), None)
            if k is not None:
                yield (own, tier, *rows[k])
                break


def _sweep_each(arrow: pa.Schema):
    """Rows (file, name, i, j, child, id, start, end), those of one group one after the other, to what ``_best_owners`` finds in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            made: list[tuple] = []
            for key, child, *row in zip(zip(*columns[:4], strict=True), *columns[4:], strict=True):
                if key != now:
                    made += _best_owners(*sides)
                    now, sides = key, ([], [])
                sides[child].append(tuple(row))
            yield from as_batch(made)
        yield from as_batch(list(_best_owners(*sides)))

    def as_batch(made: list[tuple]) -> Iterator[pa.RecordBatch]:
        if made:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    return run


def link_parents(parts: DataFrame) -> DataFrame:
    """(id, parent_id): for parts (id, file, name, parent, start_line, end_line) the part of the parent's name in the file that
    contains it with the least span, else overlaps it, else the smallest of all.

    The parts of a file and name and those that name it as parent meet in one
    sweep, not in pairs; many of them meet as pairs of blocks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = ["file", "name"]
    span = F.col("start_line").cast("long").alias("start"), F.col("end_line").cast("long").alias("end")
    known = parts.filter("id IS NOT NULL AND file IS NOT NULL")
    owners = known.filter("name IS NOT NULL").select(*keys, F.lit(0).alias("child"), "id", *span)
    children = known.filter("parent IS NOT NULL").select("file", F.col("parent").alias("name"), F.lit(1).alias("child"), "id", *span)
    blocks = lambda rows, name: rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks(owners, "owner_blocks").join(blocks(children, "child_blocks"), keys)

    def placed(rows: DataFrame, own: str, other: str, at: str, each: str) -> DataFrame:
        dealt = rows.join(sizes, keys).withColumn(at, F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        return dealt.withColumn(each, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(*keys, "i", "j", "child", "id", "start", "end")

    both = placed(owners, "owner_blocks", "child_blocks", "i", "j").unionByName(placed(children, "child_blocks", "owner_blocks", "j", "i"))
    group = [*keys, "i", "j"]
    # a fixed number of tasks: few bytes, but much to do
    dealt = both.repartition(FILES_PER_CORE * parts.sparkSession.sparkContext.defaultParallelism, *group).sortWithinPartitions(*group)
    kind = parts.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(n, T.LongType()) for n in ("t", "n", "ps", "pe")], T.StructField("parent_id", kind)])
    found = dealt.mapInArrow(_sweep_each(to_arrow_schema(schema)), schema)
    best = found.groupBy("id").agg(F.min(F.struct("t", "n", "ps", "pe", "parent_id")).alias("m"))
    return best.select("id", F.col("m.parent_id").alias("parent_id"))


def resolve_unique(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(caller_id, name, callee_id): the only symbol of that name in the same file, else the only one in imported files, else null."""
    named = symbols.select(F.col("symbol_id").alias("callee_id"), F.col("file").alias("callee_file"), "name")
    only = lambda: F.when(F.count_distinct("callee_id") == 1, F.min("callee_id"))
    keys = ["caller_id", "file", "name"]
    same = calls.join(named, "name").filter("file = callee_file").groupBy(*keys).agg(only().alias("here"))
    far = calls.join(imports.select("file", F.col("imported").alias("callee_file")).distinct(), "file").join(named, ["name", "callee_file"])
    there = far.groupBy(*keys).agg(only().alias("there"))
    return calls.join(same, keys, "left").join(there, keys, "left").select("caller_id", "name", F.coalesce("here", "there").alias("callee_id"))


def called_by(resolved: DataFrame) -> DataFrame:
    """(symbol_id, callers, n): sorted distinct callers of each symbol."""
    per = resolved.filter("callee_id IS NOT NULL").groupBy(F.col("callee_id").alias("symbol_id")).agg(F.array_sort(F.collect_set("caller_id")).alias("callers"))
    return per.withColumn("n", F.size("callers"))


def merge_aliases(chunks: DataFrame) -> DataFrame:
    """Chunks (id, repo, file, start_line, end_line, full_hash, name, tags, tokens) of one place and content as one: the least id's
    name, the union of tags, the most tokens, all ids as aliases."""
    place = ["repo", "file", "start_line", "end_line", "full_hash"]
    return chunks.groupBy(*place).agg(
        F.min("id").alias("id"), F.min_by("name", "id").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"),
        F.max("tokens").alias("tokens"), F.array_sort(F.collect_set("id")).alias("aliases"),
    )


def cross_repo_links(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, name, kind, target_repo): uses (repo, repo_ord, name, kind) of names first defined in a repository added earlier (repo, repo_ord, name)."""
    first = symbols.groupBy("name").agg(F.min_by("repo", "repo_ord").alias("target_repo"), F.min("repo_ord").alias("target_ord"))
    own = symbols.select("repo", "name").distinct()
    found = uses.join(own, ["repo", "name"], "left_anti").join(first, "name").filter("target_ord < repo_ord AND target_repo != repo")
    return found.select("repo", "name", "kind", "target_repo").distinct()


def tags_of(name: Column, signature: Column, kind: Column) -> Column:
    """Retrieval tags of a symbol."""
    lower = F.lower(F.concat_ws(" ", name, signature))
    rules = [
        ("async", F.contains(lower, F.lit("async"))), ("test", F.contains(lower, F.lit("test"))), ("handler", lower.rlike("handle|handler|on_")),
        ("getter", name.rlike("^(?:get|is|has)[A-Z_]")), ("setter", name.rlike("^set[A-Z_]")), ("constructor", name.isin("__init__", "new", "constructor")),
        ("parser", F.contains(lower, F.lit("parse"))), ("io", lower.rlike("read|write|load|save|open")), ("auth", lower.rlike("auth|login|token|password")),
        ("error", lower.rlike("error|exception|result<")), ("type", kind.isin("class", "struct", "interface", "trait", "enum", "type")),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(tag)) for tag, test in rules]))


def tests_by_name(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(path, test) of sources (path) and test files (path) whose path holds the source's name in a test's way.

    Names before ``_test.``, ``.test.``, ``.spec.`` (any end of them) and after
    ``test_``, ``test/``, ``tests/``, ``__tests__/`` (any start) are exploded,
    so that it is an equi-join; of several such places in one part of a path
    the last counts. It is always a merge join: both sides grow with the input,
    and the driver's estimates of paths made from short columns are too low.
    """
    stem = F.regexp_replace(F.lower(F.regexp_extract("path", r"([^/]*)$", 1)), r"(?<=.)\.[^.]*$", "")
    asked = sources.select("path", stem.alias("stem")).filter("stem != ''")
    lower = F.lower(F.col("path"))
    ends = F.flatten(F.array(*[F.regexp_extract_all(lower, F.lit(rf"([^/]+){p}"), F.lit(1)) for p in (r"_test\.", r"\.test\.", r"\.spec\.")]))
    starts = F.flatten(F.array(*[F.regexp_extract_all(lower, F.lit(rf"{p}([^/]+)"), F.lit(1)) for p in ("test_", "test/", "tests/", "__tests__/")]))
    cut_ends = F.transform(ends, lambda e: F.transform(F.sequence(F.lit(1), F.char_length(e)), lambda k: F.right(e, k)))
    cut_starts = F.transform(starts, lambda e: F.transform(F.sequence(F.lit(1), F.char_length(e)), lambda k: F.left(e, k)))
    tests = files.filter(is_test_file(F.col("path"))).select(F.col("path").alias("test"), F.explode(F.array_distinct(F.flatten(F.concat(cut_ends, cut_starts)))).alias("stem"))
    return asked.join(tests.hint("merge"), "stem").select("path", "test").distinct()


def previous_and_next(rows: DataFrame, group: list[str], order: str, text: str) -> DataFrame:
    """Each row with the texts before and after it in its group."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("before", F.lag(text).over(w)).withColumn("after", F.lead(text).over(w))
