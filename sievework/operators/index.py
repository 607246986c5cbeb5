"""An index of a code base: tables of files, symbols, imports and edges, queries on them, and contexts within budgets.

The index is a dict of DataFrames, so Catalyst prunes each query to the columns
and tables that it needs; on disk it is one Parquet table each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import content_hash, lines
from sievework.functions.tokens import estimate
from sievework.operators import context, graph, rank
from sievework.operators.corpus import fold_in_order
from sievework.sources import code

TABLES = ("files", "symbols", "imports", "edges")


def build_index(files: DataFrame) -> dict[str, DataFrame]:
    """The index of files (path, language, content).

    ``files``: path, language, content_hash, lines, tokens, importance (by the
    ranks of the import graph). ``symbols``: symbol_id, file, name, kind,
    signature, docstring, start_line, end_line, parent, parent_id, visibility.
    ``imports``: path, source, resolved, is_external. ``edges``: src, dst and
    edge_type: import (paths), call (symbol ids).
    """
    parsed = code.parse_symbols(files).withColumn("symbol_id", F.concat_ws(":", "file", "start_line", "name"))
    symbols = parsed.filter("kind != 'import'")
    parts = symbols.select(F.col("symbol_id").alias("id"), "file", "name", "parent", "start_line", "end_line")
    named = symbols.join(context.link_parents(parts).withColumnRenamed("id", "symbol_id"), "symbol_id", "left")
    imports = code.resolve_imports(code.imports(files).distinct(), files)
    links = imports.filter("resolved IS NOT NULL AND resolved != path").select(F.col("path").alias("src"), F.col("resolved").alias("dst")).distinct()
    used = symbols.select(F.col("symbol_id").alias("caller_id"), "file", F.explode("calls").alias("name"))
    reached = imports.filter("resolved IS NOT NULL").select(F.col("path").alias("file"), F.col("resolved").alias("imported")).distinct()
    called = graph.resolve_calls(used, symbols.select("symbol_id", "file", "name"), reached)
    calls = called.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))
    edges = links.withColumn("edge_type", F.lit("import")).unionByName(calls.withColumn("edge_type", F.lit("call")))
    listed = files.select(
        "path", "language", content_hash(F.col("content")).alias("content_hash"), F.size(lines(F.col("content"))).alias("lines"),
        estimate(F.col("content"), "claude").alias("tokens"),
    )
    ranks = graph.file_importance(links, files.select(F.col("path").alias("node"))).select(F.col("node").alias("path"), F.col("rank").alias("importance"))
    kept = ["symbol_id", "file", "name", "kind", "signature", "docstring", "start_line", "end_line", "parent", "parent_id", "visibility"]
    return {"files": listed.join(ranks, "path", "left"), "symbols": named.select(*kept), "imports": imports, "edges": edges}


def save_index(index: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below ``path``."""
    for name in TABLES:
        index[name].write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A saved index."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def index_bytes(spark: SparkSession, path: str) -> int:
    """Bytes that a saved index takes."""
    files, place = _place(spark, path)
    return files.getContentSummary(place).getLength()


def delete_index(spark: SparkSession, path: str) -> bool:
    """Whether there was an index at ``path``; it is gone now."""
    files, place = _place(spark, path)
    return files.delete(place, True)


# --- queries


def find_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of exactly that name, one for each file and line, by file and line."""
    found = symbols.filter(F.col("name") == name)
    return found.dropDuplicates(["file", "start_line"]).orderBy("file", "start_line")


def _of_name(symbols: DataFrame, name: str, id: str) -> DataFrame:
    return symbols.filter(F.col("name") == name).select(F.col("symbol_id").alias(id)).distinct()


def callers_of(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Symbols with an edge (src, dst) to a symbol of that name."""
    ids = edges.join(_of_name(symbols, name, "dst"), "dst").select(F.col("src").alias("symbol_id")).distinct()
    return symbols.join(ids, "symbol_id", "left_semi")


def callees_of(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Symbols to which a symbol of that name has an edge (src, dst)."""
    ids = edges.join(_of_name(symbols, name, "src"), "src").select(F.col("dst").alias("symbol_id")).distinct()
    return symbols.join(ids, "symbol_id", "left_semi")


def references_of(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(symbol_id, edge_type): all edges (src, dst, edge_type) to a symbol of that name, with the kind of each."""
    return edges.join(_of_name(symbols, name, "dst"), "dst").select(F.col("src").alias("symbol_id"), "edge_type").distinct()


def importers_of(edges: DataFrame, path: str) -> DataFrame:
    """(path): files that import a file."""
    return edges.filter((F.col("edge_type") == "import") & (F.col("dst") == path)).select(F.col("src").alias("path")).distinct()


def call_sites(files: DataFrame, symbols: DataFrame, name: str, around: int = 1) -> DataFrame:
    """(file, line, symbol_id, context): lines that mention a symbol of that name, with the lines around them."""
    found = graph.text_references(files, symbols.filter(F.col("name") == name))
    own = found.join(files.select(F.col("path").alias("file"), F.split("content", r"\r?\n").alias("rows")), "file")
    first = F.greatest(F.col("line") - around, F.lit(1))
    return own.select("file", "line", "symbol_id", F.array_join(F.slice("rows", first, F.col("line") + around - first + 1), "\n").alias("context"))


def _simple_cycles(links: dict) -> list[list]:
    """Cycles that a depth-first search from the least nodes on closes, each from its least node on."""
    found, done = {}, set()
    for start in sorted(links):
        if start in done:
            continue
        path, places, work = [start], {start: 0}, [iter(links[start])]
        done.add(start)
        while work:
            after = next(work[-1], None)
            if after is None:
                work.pop()
                del places[path.pop()]
            elif after in places:
                cycle = path[places[after] :]
                least = cycle.index(min(cycle))
                found.setdefault(tuple(cycle[least:] + cycle[:least]))
            elif after not in done:
                done.add(after)
                places[after] = len(path)
                path.append(after)
                work.append(iter(links[after]))
    return sorted(map(list, found))


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(component, cycle): cycles through two nodes or more, each an array of node names from its least on.

    One search for each strongly connected component, which must fit a task:
    meant for import graphs of code, whose cycles are small. ``graph.cycles``
    finds components of any size.
    """
    of = graph.cycles(edges)
    pairs = edges.filter("src != dst").select("src", "dst").distinct()
    a = of.select(F.col("node").alias("src"), "component")
    b = of.select(F.col("node").alias("dst"), F.col("component").alias("other"))
    inside = pairs.join(a, "src").join(b, "dst").filter("component = other").select("src", "dst", "component")
    kind = dict(inside.dtypes)["component"]

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        links: dict = {}
        for src, dst in sorted(zip(rows["src"], rows["dst"], strict=True)):
            links.setdefault(src, []).append(dst)
        cycles = _simple_cycles(links)
        return pd.DataFrame({"component": [rows["component"].iloc[0]] * len(cycles), "cycle": [[str(n) for n in c] for c in cycles]})

    return inside.groupBy("component").applyInPandas(search, f"component {kind}, cycle array<string>")


def dependency_stats(files: DataFrame, imports: DataFrame) -> DataFrame:
    """One row: files, edges between them, external dependencies, groups of files on cycles."""
    links = imports.filter("resolved IS NOT NULL AND resolved != path").select(F.col("path").alias("src"), F.col("resolved").alias("dst")).distinct()
    groups = graph.cycles(links).agg(F.count_distinct("component").alias("cycles"))
    edges = links.agg(F.count("*").alias("edges"))
    external = imports.filter("is_external").agg(F.count_distinct("source").alias("external"))
    rows = files.agg(F.count("*").alias("files"))
    for one in (edges, external, groups):  # one row each
        rows = rows.crossJoin(F.broadcast(one))
    return rows


def cache_stats(cache: DataFrame, now: Column | None = None) -> DataFrame:
    """One row: files, tokens, bytes of cached files (size, tokens, updated_at), and the seconds since the last update."""
    now = F.current_timestamp() if now is None else now
    age = F.unix_timestamp(now) - F.unix_timestamp(F.max("updated_at"))
    return cache.agg(
        F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.sum("size").alias("bytes"), F.greatest(age, F.lit(0)).alias("age_seconds")
    )


def multi_repo_stats(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(repo, symbols, names, links): of symbols (repo, name) and links between repositories (repo, target_repo); a row of all under null."""
    per = symbols.rollup("repo").agg(F.count("*").alias("symbols"), F.count_distinct("name").alias("names"))
    out = links.rollup("repo").agg(F.count("*").alias("links")).withColumnRenamed("repo", "__repo")
    return per.join(out, F.col("repo").eqNullSafe(F.col("__repo")), "left").select("repo", "symbols", "names", F.coalesce("links", F.lit(0)).alias("links"))


def lazy_context(files: DataFrame, changed: DataFrame, depth: int = 1) -> DataFrame:
    """(path, depth): changed files (path) and what they import, directly or in ``depth`` steps.

    Only the files of each step are read for imports, so nothing else is parsed.
    """
    known = graph.cut(changed.select("path").distinct().join(files.select("path"), "path", "left_semi").withColumn("depth", F.lit(0)))
    frontier = known
    for step in range(1, depth + 1):
        own = files.join(frontier.select("path"), "path", "left_semi")
        found = code.resolve_imports(code.imports(own), files.select("path"))
        new = found.filter("resolved IS NOT NULL").select(F.col("resolved").alias("path")).distinct().join(known, "path", "left_anti")
        frontier = graph.cut(new.withColumn("depth", F.lit(step)))
        known = known.unionByName(frontier)
    return known


def context_impact(index: dict[str, DataFrame], changed: DataFrame, depth: int = 3) -> DataFrame:
    """(path, level, is_test, level_of_impact) of changed files (path) and the files that import them, directly or in ``depth`` steps."""
    links = index["edges"].filter("edge_type = 'import'").select("src", "dst")
    starts = changed.select(F.col("path").alias("node")).distinct()
    users = graph.reachable(links, starts, depth, backwards=True).unionByName(starts.withColumn("depth", F.lit(0)))
    rows = users.select(F.col("node").alias("path"), F.col("depth").alias("level"), context.is_test_file(F.col("node")).alias("is_test"))
    totals = rows.agg(F.count_if(F.col("level") == 1).alias("direct"), F.count_if(F.col("level") > 1).alias("transitive"))
    return rows.crossJoin(F.broadcast(totals)).select(  # one row
        "path", "level", "is_test", rank.impact_level(F.col("direct"), F.col("transitive")).alias("impact")
    )


# --- budgets


def _greedy(rows: DataFrame, order: list[Column], carry: list[str], used: int, budget: int) -> DataFrame:
    """``rows`` with ``kept``: in order, whether the tokens still fit."""

    def step(total: int, tokens: int) -> tuple:
        fits = total + tokens <= budget
        return (total + tokens if fits else total), (fits,)

    done = fold_in_order(rows.withColumn("all", F.lit(0)), ["all"], order, carry, "tokens", lambda: used, step, "kept boolean")
    return done.drop("all")


def context_budget(files: DataFrame, budget: int) -> DataFrame:
    """(path, role, relevance, tokens) that fit: changed files always, then dependents, then tests, each by relevance as long as they fit.

    ``files``: path, role (changed, dependent or test), relevance, tokens. A
    file that doesn't fit is left out, and smaller ones after it may still come.
    """
    changed = files.filter("role = 'changed'").select("path", "role", "relevance", "tokens")
    used = changed.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    tier = F.when(F.col("role") == "dependent", 0).otherwise(1)
    others = _greedy(files.filter("role != 'changed'"), [tier, F.desc("relevance"), F.col("path")], ["path", "role", "relevance", "tokens"], used, budget)
    return changed.unionByName(others.filter("kept").drop("kept"))


def snippet_score(relevance: Column, reason: Column) -> Column:
    """A snippet's score: its file's relevance, and more for what the reason says."""
    has = lambda words: F.contains(reason, F.lit(words))
    more = F.when(has("changed symbol"), 0.3).when(has("dependent symbol"), 0.2).when(has("diff hunk"), 0.1).when(has("file removed"), 0.25).otherwise(0.0)
    return relevance + more


def diff_budget(snippets: DataFrame, changed_tokens: int, budget: int) -> DataFrame:
    """Snippets that fit beside the changed files: by score, then fewer tokens, then place.

    ``snippets``: path, role, relevance, ord (place in the file), reason, tokens.
    A budget of 0 keeps all; files without a snippet left are gone.
    """
    if budget <= 0:
        return snippets
    names = ["path", "role", "relevance", "ord", "reason", "tokens"]
    score = snippet_score(F.col("relevance"), F.col("reason"))
    order = [F.desc(score), F.col("tokens"), F.when(F.col("role") == "dependent", 0).otherwise(1), F.col("path"), F.col("ord")]
    scored = snippets.withColumn("order", F.struct(*[(-score).alias("s") if k == 0 else o.alias(f"o{k}") for k, o in enumerate(order)]))
    return _greedy(scored, [F.col("order")], names, changed_tokens, budget).filter("kept").drop("kept")


def isolated(groups: DataFrame, key: str, run, schema: str) -> tuple[DataFrame, DataFrame]:
    """(results, failures) of ``run`` (a pandas DataFrame to one) on each group, as for a batch of repositories.

    A group that fails gives one row (key, error) and none of the results; the
    others aren't touched.
    """
    kind = dict(groups.dtypes)[key]

    def guarded(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows[key].iloc[0]
        try:
            made = run(rows)
            return pd.DataFrame({"__key": [name] * len(made), "__rows": made.to_dict("records"), "__error": None})
        except Exception as error:  # noqa: BLE001 - any failure of one group is a row
            return pd.DataFrame({"__key": [name], "__rows": [None], "__error": [f"{type(error).__name__}: {error}"]})

    done = graph.cut(groups.groupBy(key).applyInPandas(guarded, f"__key {kind}, __rows struct<{schema}>, __error string"))
    good = done.filter("__error IS NULL").select(F.col("__key").alias(f"{key}"), "__rows.*")
    return good, done.filter("__error IS NOT NULL").select(F.col("__key").alias(key), F.col("__error").alias("error"))
