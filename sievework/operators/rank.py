"""Ranking and scoring of files, symbols and changes; analysis formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import tables as T
from sievework.functions.text import contains_any, starts_with_any
from sievework.operators.state import numbered


def _file_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*)$", 1))


def file_importance(path: Column, symbols: Column) -> Column:
    """0.05 to 1 by the first rule that fits, with boosts for symbols and telling names outside tests and vendored code."""
    name, whole = _file_name(path), F.lower(path)
    vendored, test = contains_any(whole, T.VENDOR_PIECES), contains_any(whole, T.TEST_PIECES)
    base = (
        F.when(vendored, 0.05)
        .when(test, 0.15)
        .when(contains_any(name, T.CONFIG_PIECES) | contains_any(whole, T.CONFIG_PIECES), 0.25)
        .when(starts_with_any(name, T.DOC_PREFIXES), 0.35)
        .when(name.isin(T.CRITICAL_FILES), 1.0)
        .when(starts_with_any(name, T.ENTRY_PREFIXES), 0.9)
        .when(contains_any(whole, T.CORE_DIRECTORIES), 0.75)
        .otherwise(0.5)
    )
    boosted = F.least(base + F.least(symbols / 50.0, F.lit(0.15)), F.lit(1.0))
    boosted = F.when(contains_any(name, T.BOOSTED_NAMES), F.least(boosted + 0.1, F.lit(1.0))).otherwise(boosted)
    return F.when(vendored | test, base).otherwise(boosted)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def fast_rank(path: Column) -> Column:
    """A whole number by the path alone; lower comes first."""
    score = F.lit(1000)
    score = score + F.when(_any([path.endswith(e) for e in T.FAST_ENTRY_ENDS]), -5000).otherwise(0)
    score = score + F.when(_any([path.endswith(e) for e in T.FAST_CONFIG_ENDS]), -3000).otherwise(0)
    for value, pieces in T.FAST_PIECES:
        tests = [F.contains(path, F.lit(p)) for p in pieces]
        if "/src/" in pieces:
            tests.append(path.startswith("src/"))
        if "/docs/" in pieces:
            tests.append(path.endswith(".md"))
        score = score + F.when(_any(tests), value).otherwise(0)
    return score


def chunk_priority(path: Column) -> Column:
    """0 to 100: entry points and manifests high, tests, helpers and documentation low."""
    lower, out = F.lower(path), F.lit(50.0)
    for value, ends, pieces, starts in reversed(T.CHUNK_PRIORITIES):
        fits = [lower.endswith(e) for e in ends] + [F.contains(lower, F.lit(p)) for p in pieces] + [lower.startswith(s) for s in starts]
        out = F.when(_any(fits), value).otherwise(out)
    return out


def importance_bucket(score: Column) -> Column:
    return F.when(score > 0.8, "critical").when(score > 0.6, "high").when(score > 0.3, "normal").otherwise("low")


def reference_counts(symbols: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """``symbols`` with ``references``: how often its name is called or imported (calls, imports: name)."""
    used = calls.select("name").unionByName(imports.select("name")).groupBy("name").agg(F.count("*").alias("n"))
    return symbols.join(used, "name", "left").withColumn("references", F.coalesce("n", F.lit(0))).drop("n")


def symbol_scores(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``symbols`` (file, kind, references, start_line, end_line) with ``score``: references, kind, file importance and length, weighted."""
    most = symbols.agg(F.greatest(F.max("references"), F.lit(1)).alias("__refs"), F.greatest(F.max(F.col("end_line") - F.col("start_line") + 1), F.lit(1)).alias("__lines"))
    kinds = F.create_map(*[F.lit(x) for pair in T.KIND_IMPORTANCE.items() for x in pair])
    length = F.col("end_line") - F.col("start_line") + 1
    score = (
        0.4 * F.col("references") / F.col("__refs")
        + 0.25 * F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit(0.3))
        + 0.2 * F.col("importance")
        + 0.15 * F.least(length / F.col("__lines"), F.lit(1.0))
    )
    rows = symbols.join(files.select("file", "importance"), "file").crossJoin(F.broadcast(most))  # one row
    return rows.withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).drop("__refs", "__lines", "importance")


def updated_importance(files: DataFrame, scores: DataFrame) -> DataFrame:
    """A file's importance and the mean score of its symbols, averaged."""
    mean = scores.groupBy("file").agg(F.avg("score").alias("__mean"))
    value = F.when(F.col("__mean").isNull(), F.col("importance")).otherwise((F.col("importance") + F.col("__mean")) / 2)
    return files.join(mean, "file", "left").withColumn("importance", value).drop("__mean")


def ranks(rows: DataFrame, group: list[str], score: str, order: str, parts: int = 4) -> DataFrame:
    """``rows`` with rank, dense_rank, percent_rank and quantile (of ``parts``) within their group by descending score, and the sum and mean of the
    scores up to each and of the three around it, ties in these by ``order``. For groups that fit a sorted partition each."""
    by_score = Window.partitionBy(*group).orderBy(F.desc(score))
    in_order = Window.partitionBy(*group).orderBy(F.desc(score), order)
    return rows.withColumns(
        {
            "rank": F.rank().over(by_score), "dense_rank": F.dense_rank().over(by_score), "percent_rank": F.percent_rank().over(by_score),
            "quantile": F.ntile(parts).over(in_order), "running": F.sum(score).over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
            "around": F.avg(score).over(in_order.rowsBetween(-1, 1)),
        }
    )


def rank_all(rows: DataFrame, score: str, order: str) -> DataFrame:
    """``rows`` with ``rank`` from 1 by descending score, ties by ``order``; a distributed sort."""
    return numbered(rows, [F.desc(score), F.col(order)], "rank").withColumn("rank", F.col("rank") + 1)


def impact_level(direct: Column, transitive: Column) -> Column:
    """From dependent files and affected symbols."""
    return (
        F.when((direct > 20) | (transitive > 50), "critical")
        .when((direct > 10) | (transitive > 20), "high")
        .when((direct > 3) | (transitive > 5), "medium")
        .otherwise("low")
    )


def halstead(n1: Column, n2: Column, N1: Column, N2: Column) -> dict[str, Column]:  # noqa: N803
    """The measures from distinct and total operators and operands."""
    zero = F.lit(0.0)
    vocabulary, length = n1 + n2, N1 + N2
    volume = F.when(vocabulary > 0, length * F.log2(vocabulary.cast("double"))).otherwise(zero)
    difficulty = F.when(n2 > 0, n1 / 2.0 * (N2 / n2)).otherwise(zero)
    effort = volume * difficulty
    estimated = F.when(n1 > 0, n1 * F.log2(n1.cast("double"))).otherwise(zero) + F.when(n2 > 0, n2 * F.log2(n2.cast("double"))).otherwise(zero)
    return {
        "vocabulary": vocabulary, "length": length, "calculated_length": estimated, "volume": volume, "difficulty": difficulty,
        "effort": effort, "time": effort / 18.0, "bugs": volume / 3000.0,
    }


def maintainability(volume: Column, cyclomatic: Column, loc: Column) -> Column:
    """171 - 5.2 ln V - 0.23 CC - 16.2 ln LOC, scaled to 0..100."""
    raw = 171 - 5.2 * F.log(F.greatest(volume, F.lit(1.0))) - 0.23 * cyclomatic - 16.2 * F.log(F.greatest(loc.cast("double"), F.lit(1.0)))
    return F.least(F.greatest(raw * 100 / 171, F.lit(0.0)), F.lit(100.0))


#: measure: warn from, error from (maintainability: below)
GATES = {"cyclomatic": (10, 20), "cognitive": (15, 30), "nesting": (4, 6), "parameters": (5, 8), "maintainability": (40, 20)}


def complexity_gates(rows: DataFrame, key: str) -> DataFrame:
    """(key, measure, value, severity) of measures over their thresholds."""
    made = []
    for name, (warn, error) in GATES.items():
        value = F.col(name).cast("double")
        over = (lambda limit, v=value: v < limit) if name == "maintainability" else (lambda limit, v=value: v > limit)
        severity = F.when(over(error), "error").when(over(warn), "warning")
        made.append(F.struct(F.lit(name).alias("measure"), value.alias("value"), severity.alias("severity")))
    out = rows.select(key, F.explode(F.array(*made)).alias("g")).filter("g.severity IS NOT NULL")
    return out.select(key, "g.measure", "g.value", "g.severity")


def unused(definitions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Definitions that nothing refers to."""
    return definitions.join(references.select(key).distinct(), key, "left_anti")


def _snapshot(symbols: DataFrame, side: str) -> DataFrame:
    """Symbols (name, file, signature, visibility, extends) with what is compared between versions, named for a side."""
    signature = F.coalesce(F.col("signature"), F.lit(""))
    generic = F.regexp_extract(signature, r"^[^(<]*<([^>]*)>", 1)
    level = F.create_map(*[F.lit(x) for pair in VISIBILITIES.items() for x in pair])
    own = {
        "file": F.col("file"), "level": F.try_element_at(level, F.col("visibility")), "returns": return_type(signature), "parameters": parameters(signature),
        "is_async": signature.rlike(r"\basync\b"), "generics": F.when(generic != "", F.size(F.split(generic, ","))).otherwise(0), "extends": F.col("extends"),
    }
    return symbols.select("name", *[c.alias(f"{side}_{n}") for n, c in own.items()])


CHANGE = "array<struct<change:string,severity:string,before:string,after:string>>"
#: How far a symbol can be seen.
VISIBILITIES = {"private": 0, "internal": 1, "protected": 2, "public": 3}


def breaking_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, file, change, severity, before, after): what breaks users of the old version's public symbols.

    Both: name, file, signature, visibility, extends. A symbol may change in
    several ways, and gives a row for each; parameters that differ give one row
    each, in place.
    """
    both = _snapshot(old, "old").filter("old_level = 3").join(_snapshot(new, "new"), "name", "left")
    o, n = lambda c: F.col(f"old_{c}"), lambda c: F.col(f"new_{c}")
    there = n("file").isNotNull()
    text = lambda c: c.cast("string")

    def found(change: str, severity: str, test: Column, before: Column, after: Column) -> Column:
        return F.when(test, F.struct(F.lit(change).alias("change"), F.lit(severity).alias("severity"), text(before).alias("before"), text(after).alias("after")))

    sizes = F.size(o("parameters")), F.size(n("parameters"))
    mode = lambda c: F.when(c, "async").otherwise("sync")
    none = F.lit(None)
    single = [
        found("removed", "critical", ~there, none, none),
        found("moved", "medium", there & (o("file") != n("file")) & (n("level") == 3), o("file"), n("file")),
        found("visibility_reduced", "critical", n("level") < o("level"), o("level"), n("level")),
        found("return_type_changed", "high", o("returns") != n("returns"), o("returns"), n("returns")),
        found("parameter_added", "high", there & (sizes[1] > sizes[0]), sizes[0], sizes[1]),
        found("parameter_removed", "high", there & (sizes[1] < sizes[0]), sizes[0], sizes[1]),
        found("async_changed", "high", there & (o("is_async") != n("is_async")), mode(o("is_async")), mode(n("is_async"))),
        found("generic_changed", "high", there & (o("generics") != n("generics")), o("generics"), n("generics")),
        found("type_constraint_changed", "medium", there & ~o("extends").eqNullSafe(n("extends")), o("extends"), n("extends")),
    ]
    common = F.greatest(F.least(*sizes), F.lit(1))
    typed = F.transform(
        F.sequence(F.lit(1), common),
        lambda i: found("parameter_type_changed", "high", F.get(o("parameters"), i - 1) != F.get(n("parameters"), i - 1), F.get(o("parameters"), i - 1), F.get(n("parameters"), i - 1)),
    )
    all_changes = F.array_compact(F.concat(F.array(*single), F.coalesce(typed, F.array().cast(CHANGE))))
    rows = both.select("name", F.coalesce(n("file"), o("file")).alias("file"), F.explode(all_changes).alias("c"))
    return rows.select("name", "file", "c.change", "c.severity", "c.before", "c.after")


def breaking_summary(changes: DataFrame) -> DataFrame:
    """One row: changes in all and of each severity, and the files and symbols affected."""
    of = lambda kind: F.count_if(F.col("severity") == kind).alias(kind)
    kinds = ("critical", "high", "medium", "low")
    return changes.agg(F.count("*").alias("total"), *[of(k) for k in kinds], F.count_distinct("file").alias("files"), F.count_distinct("name").alias("symbols"))


def type_roots(types: DataFrame) -> DataFrame:
    """Types (name, parent) without a parent."""
    return types.groupBy("name").agg(F.max("parent").alias("p")).filter("p IS NULL").select("name")


def type_leaves(types: DataFrame) -> DataFrame:
    """Types that none extends."""
    return types.select("name").distinct().join(types.select(F.col("parent").alias("name")).distinct(), "name", "left_anti")


def common_symbols(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names in both repositories."""
    return left.select("name").intersect(right.select("name"))


def dead_code_confidence(visibility: Column, kind: Column) -> Column:
    """How sure it is that an unreferenced symbol is dead; 0.95 at most."""
    by_kind = F.when(kind.isin("function", "method"), 0.1).when(kind.isin("class", "struct"), 0.05).when(kind.isin("variable", "constant"), 0.15).otherwise(0.0)
    return F.least(F.lit(0.5) + F.when(visibility.isin("private", "internal"), 0.3).otherwise(0.0) + by_kind, F.lit(0.95))


def is_entry_point(name: Column, kind: Column, visibility: Column, language: Column) -> Column:
    """Symbols that are used from outside: by common names, test names, and each language's ways."""
    upper = name.rlike(r"^\p{Lu}")
    common = name.isin("main", "init", "__init__") | name.rlike("^(?:test_|Test)|(?:_test|Test)$")
    own = (
        F.when(language == "python", name.rlike("^__.*__$"))
        .when(language.isin("javascript", "typescript"), upper & kind.isin("class", "function"))
        .when(language == "rust", visibility == "public")
        .when(language == "go", upper)
        .when(language.isin("java", "kotlin"), (visibility == "public") & (kind == "method"))
        .when(language == "ruby", name.rlike("^(?:initialize$|before_|after_)"))
        .when(language == "php", name.startswith("__"))
        .when(language == "swift", name.isin("viewDidLoad", "applicationDidFinishLaunching"))
        .when(language == "elixir", name.rlike("^(?:start$|child_spec$|handle_)"))
        .otherwise(False)
    )
    return common | own


def dead_code(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(file, name, kind, confidence) of symbols (file, name, kind, visibility, language) that nothing names and that are no entry points."""
    rows = symbols.filter(~is_entry_point(F.col("name"), F.col("kind"), F.col("visibility"), F.col("language")) & (F.col("kind") != "import"))
    found = rows.join(references.select("name").distinct(), "name", "left_anti")
    return found.select("file", "name", "kind", dead_code_confidence(F.col("visibility"), F.col("kind")).alias("confidence"))


def exported_symbols(symbols: DataFrame) -> DataFrame:
    """Exports, and public declarations."""
    kinds = ["function", "class", "struct", "trait", "enum", "interface", "type", "constant", "module"]
    return symbols.filter((F.col("kind") == "export") | ((F.col("visibility") == "public") & F.col("kind").isin(kinds)))


def parameters(signature: Column) -> Column:
    """The parameters of a signature: its first parentheses' content, split at commas outside of brackets."""
    inner = F.regexp_extract(signature, r"(?s)\((.*)\)", 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c.rlike(r"[(\[{<]"), 1).when(c.rlike(r"[)\]}>]"), -1).otherwise(0)
        cut = (c == ",") & (a["depth"] == 0)
        return F.struct(
            depth.alias("depth"), F.when(cut, "").otherwise(F.concat(a["now"], c)).alias("now"), F.when(cut, F.array_append(a["out"], F.trim(a["now"]))).otherwise(a["out"]).alias("out")
        )

    done = F.aggregate(F.split(inner, ""), start, step, lambda a: F.array_append(a["out"], F.trim(a["now"])))
    return F.filter(done, lambda p: p != "")


def return_type(signature: Column) -> Column:
    """What follows ``->`` or ``):`` in a signature; else null."""
    return F.nullif(F.trim(F.regexp_extract(signature, r"(?s)\)\s*(?:->|:)\s*([^{]*?)\s*[:{]?\s*$", 1)), F.lit(""))


def signature_changes(old: Column, new: Column) -> Column:
    """An array of what differs between two signatures: parameter_added, parameter_removed, parameter_changed, return_type_changed."""
    a, b = parameters(old), parameters(new)
    name = lambda p: F.regexp_extract(p, r"(\w+)", 1)
    before, after = F.transform(a, name), F.transform(b, name)
    common = F.size(F.array_intersect(before, after))
    changed = F.size(F.array_intersect(a, b)) < common
    tests = [
        ("parameter_added", F.size(F.array_except(after, before)) > 0), ("parameter_removed", F.size(F.array_except(before, after)) > 0),
        ("parameter_changed", changed), ("return_type_changed", ~return_type(old).eqNullSafe(return_type(new))),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in tests]))
