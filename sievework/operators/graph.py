"""Graphs as (src, dst) edge DataFrames: ranks, components, reachability, order.

Iterations are driver loops of joins and aggregations; the result of each round
is a table in the shared folder, so plans stay small and nothing is computed
twice. Node and edge sets are never collected; only one-row aggregates steer the
loops.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.shared import stored


#: Edges that one task may hold, in some hundred bytes each.
SMALL_EDGES = 500_000
#: Found pairs that a search gives back at once, at least.
SEARCH_ROWS = 100_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    return stored(df, "graph")


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


class _Grown:
    """Rows found round by round. The tables of some rounds are joined to one now and then, so that few are read."""

    def __init__(self, first: DataFrame) -> None:
        self.tables, self.last, self.rounds = [first], first, 1

    def add(self, new: DataFrame) -> None:
        self.last = cut(new)
        self.tables.append(self.last)
        self.rounds += 1
        if len(self.tables) > 6:
            self.tables = [cut(self.all())]

    def all(self) -> DataFrame:
        return _union(self.tables)

    @property
    def more(self) -> bool:
        """Whether the last round found anything."""
        return not self.last.isEmpty()


def nodes_of(edges: DataFrame) -> DataFrame:
    """(node): every end of an edge once."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def pagerank(
    edges: DataFrame,
    nodes: DataFrame | None = None,
    damping: float = 0.85,
    iterations: int = 20,
    tolerance: float = 0.0,
    dangling: bool = True,
    by_maximum: bool = False,
) -> DataFrame:
    """(node, rank). Parallel edges count.

    ``dangling``: the mass of nodes without edges out is spread over all nodes.
    ``tolerance``: stop when the sum of absolute changes is below it.
    ``by_maximum``: ranks are divided by the largest.

    Parallel edges are one weighted edge. A round is two joins and one
    aggregation. What the
    next round needs in sums is observed while a round's table is written.
    """
    nodes = nodes if nodes is not None else nodes_of(edges)
    weights = cut(edges.groupBy("src", "dst").agg(F.count("*").alias("w")))
    degree = weights.groupBy("src").agg(F.sum("w").alias("degree"))
    shares = cut(weights.join(degree, "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("share")))
    state = cut(nodes.join(degree, nodes["node"] == degree["src"], "left").select("node", F.col("src").isNull().alias("sink")))
    n = state.count()
    if n == 0:
        return state.select("node", F.lit(0.0).alias("rank"))
    ranks = state.withColumn("rank", F.lit(1.0 / n))
    lost = state.filter("sink").count() / n
    for k in range(iterations):
        gained = shares.join(ranks, shares["src"] == ranks["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("gain"))
        rank = F.lit((1 - damping) / n + (lost * damping / n if dangling else 0.0)) + F.coalesce("gain", F.lit(0.0)) * damping
        made = ranks.withColumnRenamed("rank", "old").join(gained, "node", "left").select("node", "sink", rank.alias("rank"), F.abs(rank - F.col("old")).alias("change"))
        seen = Observation()
        sums = F.sum(F.when(F.col("sink"), F.col("rank"))).alias("lost"), F.sum("change").alias("change"), F.max("rank").alias("most")
        ranks = cut(made.observe(seen, *sums)).drop("change")
        lost, most = seen.get["lost"] or 0.0, seen.get["most"]
        if tolerance and seen.get["change"] < tolerance:
            break
    return ranks.select("node", (F.col("rank") / (most if by_maximum and iterations else 1.0)).alias("rank"))


def map_pagerank(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Symbol ranks of a map: 20 rounds at most, stop at 1e-4."""
    return pagerank(edges, nodes, tolerance=1e-4)


def file_importance(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Importance in a dependency graph: 30 rounds, no spreading, divided by the largest."""
    return pagerank(edges, nodes, iterations=30, dangling=False, by_maximum=True)


def _links(edges: DataFrame) -> dict:
    """{src: [dst]} of at most ``SMALL_EDGES`` edges."""
    table = edges.toArrow()
    out: dict = {}
    for src, dst in zip(table["src"].to_pylist(), table["dst"].to_pylist(), strict=True):
        out.setdefault(src, []).append(dst)
    return out


def _search_each(links, max_depth: int | None, arrow: pa.Schema):
    """(src, dst, depth) of all that each source (src, firsts: its edges' ends) reaches, by breadth-first searches.

    Sources with the same ends that come one after the other share a search.
    """
    kind = arrow.field("dst").type

    def reached(firsts: list, after: dict) -> tuple[pa.Array, pa.Array]:
        found: dict = {}
        others, depth = firsts, 0
        while others and (max_depth is None or depth < max_depth):
            depth += 1
            new = []
            for node in others:
                if node not in found:
                    found[node] = depth
                    new.append(node)
            others = [other for node in new for other in after.get(node, ())]
        return pa.array(list(found), kind), pa.array(list(found.values()), pa.int32())

    def joined(starts: list, ends: list[pa.Array], depths: list[pa.Array]) -> pa.RecordBatch:
        sources = pa.array(starts, arrow.field("src").type).take(pa.array(np.repeat(np.arange(len(starts)), [len(e) for e in ends])))
        return pa.record_batch([sources, pa.concat_arrays(ends), pa.concat_arrays(depths)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = links.value
        before = None
        starts: list = []
        ends: list[pa.Array] = []
        depths: list[pa.Array] = []
        size = 0
        for batch in batches:
            for start, firsts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if firsts != before:
                    before, (nodes, far) = firsts, reached(firsts, after)
                starts.append(start)
                ends.append(nodes)
                depths.append(far)
                size += len(nodes)
                if size >= SEARCH_ROWS:
                    yield joined(starts, ends, depths)
                    starts, ends, depths, size = [], [], [], 0
        if size:
            yield joined(starts, ends, depths)

    return run


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth): all reachable pairs with the least number of steps. For graphs whose closure is wanted whole.

    Only edges from nodes that have an edge in can be second or later steps. Up
    to ``SMALL_EDGES`` of these are sent to all executors, and each task searches
    from its share of the sources and their own edges; if there are more, or one
    source has more, edges are joined round by round. A null end is found, but
    isn't gone on from.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from sievework.functions.shared import FILES_PER_CORE

    step = cut(edges.select("src", "dst").distinct())
    later = cut(step.join(step.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
    if later.count() <= SMALL_EDGES and (step.groupBy("src").count().agg(F.max("count")).first()[0] or 0) <= SMALL_EDGES:
        spark = step.sparkSession
        links = spark.sparkContext.broadcast(_links(later))
        # a fixed number of tasks: few bytes come in, but much may go out
        dealt = step.repartition(FILES_PER_CORE * spark.sparkContext.defaultParallelism, "src").groupBy("src")
        firsts = F.sort_array(F.collect_list("dst"))
        own = dealt.agg(F.when(F.count("dst") < F.count("*"), F.array_append(firsts, F.lit(None))).otherwise(firsts).alias("firsts"))
        schema = T.StructType([*step.schema.fields, T.StructField("depth", T.IntegerType())])
        return own.sortWithinPartitions("firsts").mapInArrow(_search_each(links, max_depth, to_arrow_schema(schema)), schema)
    hop = step.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    known = _Grown(step.withColumn("depth", F.lit(1)))
    while (max_depth is None or known.rounds < max_depth) and known.more:
        new = known.last.join(hop, "dst").select("src", F.col("next").alias("dst")).distinct()
        old = known.all().select(F.col("src").alias("a"), F.col("dst").alias("b"))
        known.add(new.join(old, F.col("src").eqNullSafe(F.col("a")) & F.col("dst").eqNullSafe(F.col("b")), "left_anti").withColumn("depth", F.lit(known.rounds + 1)))
    return known.all()


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, backwards: bool = False) -> DataFrame:
    """(node, depth) reached from ``starts`` (node), without the starts; ``backwards`` follows edges to their source."""
    a, b = ("dst", "src") if backwards else ("src", "dst")
    step = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    known = _Grown(cut(starts.select("node").distinct().withColumn("depth", F.lit(0))))
    while (max_depth is None or known.rounds <= max_depth) and known.more:
        new = known.last.select("node").join(step, "node").select(F.col("next").alias("node")).distinct()
        known.add(new.join(known.all(), "node", "left_anti").withColumn("depth", F.lit(known.rounds)))
    return known.all().filter("depth > 0")


def _components(links: dict) -> dict:
    """{node: least node of its strongly connected component}, by Tarjan's search with an explicit stack."""
    place: dict = {}
    low: dict = {}
    name: dict = {}
    open_nodes: list = []
    for start in links:
        if start in place:
            continue
        place[start] = low[start] = len(place)
        open_nodes.append(start)
        work = [(start, iter(links[start]))]
        while work:
            node, after = work[-1]
            found = next(after, None)
            if found is not None:
                if found not in place:
                    place[found] = low[found] = len(place)
                    open_nodes.append(found)
                    work.append((found, iter(links.get(found, ()))))
                elif found not in name:
                    low[node] = min(low[node], place[found])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[node])
            if low[node] == place[node]:
                own = [open_nodes.pop()]
                while own[-1] != node:
                    own.append(open_nodes.pop())
                name.update(dict.fromkeys(own, min(own)))
    return name


def _searched(edges: DataFrame) -> DataFrame:
    """(node, component) of the components of at least two nodes, in one task."""
    kind = dict(edges.dtypes)["src"]

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        links: dict = {}
        for src, dst in zip(rows["src"], rows["dst"], strict=True):
            links.setdefault(src, []).append(dst)
        name = _components(links)
        sizes = Counter(name.values())
        kept = [(n, c) for n, c in name.items() if sizes[c] > 1]
        return pd.DataFrame({"node": [n for n, _ in kept], "component": [c for _, c in kept]}).astype({"node": rows["src"].dtype, "component": rows["src"].dtype})

    return cut(edges.groupBy(F.lit(0).alias("all")).applyInPandas(lambda rows: search(rows), f"node {kind}, component {kind}"))


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on a cycle through at least two nodes; a component is named by its least node.

    Nodes without edges in or out are trimmed first. Of what is left, up to
    ``SMALL_EDGES`` edges are searched by one task; more are coloured forwards
    and backwards from the least node of each colour until all components are
    found, or few enough edges are left.
    """
    rest = cut(edges.filter("src != dst").select("src", "dst").distinct())
    found: list[DataFrame] = []
    while True:
        size = -1
        while size != (size := rest.count()):  # trim
            outs, ins = rest.select(F.col("src").alias("node")).distinct(), rest.select(F.col("dst").alias("node")).distinct()
            both = outs.join(ins, "node")
            left = rest.join(both.withColumnRenamed("node", "src"), "src").join(both.withColumnRenamed("node", "dst"), "dst")
            rest = cut(left.select("src", "dst"))
        if size == 0:
            break
        if size <= SMALL_EDGES:
            found.append(_searched(rest))
            break
        color = nodes_of(rest).withColumn("color", F.col("node"))
        before = None
        while True:  # the least node that reaches each node
            pulled = rest.join(color, rest["src"] == color["node"]).groupBy("dst").agg(F.min("color").alias("other"))
            color = cut(
                color.join(pulled, color["node"] == pulled["dst"], "left").select("node", F.least("color", F.coalesce("other", "color")).alias("color"))
            )
            state = color.agg(F.sum(F.xxhash64("node", "color").cast("decimal(38,0)"))).first()[0]
            if state == before:
                break
            before = state
        of = {x: color.select(F.col("node").alias(x), F.col("color").alias(f"{x}_color")) for x in ("src", "dst")}
        inside = cut(rest.join(of["src"], "src").join(of["dst"], "dst").filter("src_color = dst_color").select("src", "dst", F.col("src_color").alias("color")))
        grown = _Grown(cut(color.filter("node = color")))
        while grown.more:  # backwards from each colour's name, within the colour
            new = grown.last.select(F.col("node").alias("dst"), "color").join(inside, ["dst", "color"]).select(F.col("src").alias("node"), "color").distinct()
            grown.add(new.join(grown.all(), ["node", "color"], "left_anti"))
        reach = grown.all()
        many = reach.groupBy("color").agg(F.count("*").alias("n")).filter("n > 1").select("color")
        found.append(reach.join(many, "color").select("node", F.col("color").alias("component")))
        done = reach.select("node")
        rest = cut(
            rest.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti")
        )
    if not found:
        return nodes_of(edges.limit(0)).withColumn("component", F.col("node"))
    out = _union(found)
    names = out.groupBy("component").agg(F.min("node").alias("name"))
    return out.join(names, "component").select("node", F.col("name").alias("component"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, callers, callees): distinct neighbours in and out."""
    pairs = edges.select("src", "dst").distinct()
    ins = pairs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("callers"))
    outs = pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("callees"))
    zero = F.lit(0).cast("long")
    return ins.join(outs, "node", "full_outer").select("node", F.coalesce("callers", zero).alias("callers"), F.coalesce("callees", zero).alias("callees"))


def _levels(edges: pd.DataFrame) -> pd.DataFrame:
    """(node, level) of one table of distinct edges."""
    after: dict = {}
    before: Counter = Counter()
    for src, dst in zip(edges["src"], edges["dst"], strict=True):
        after.setdefault(src, []).append(dst)
        before[dst] += 1
    nodes = dict.fromkeys([*edges["src"], *edges["dst"]])
    ready, level, found = [n for n in nodes if not before[n]], 0, {}
    while ready:
        found.update(dict.fromkeys(ready, level))
        new = []
        for node in ready:
            for other in after.get(node, ()):
                before[other] -= 1
                if not before[other]:
                    new.append(other)
        ready, level = new, level + 1
    return pd.DataFrame({"node": list(nodes), "level": pd.array([found.get(n) for n in nodes], "Int32")}).astype({"node": edges["src"].dtype})


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): level 0 has no edge in, each other one more than its last predecessor; nodes on or behind cycles: null.

    Up to ``SMALL_EDGES`` edges are ordered by one task. Of more, edges into
    nodes without edges out are put aside, as these nodes follow from the levels
    of the others; that is done again while at least half of the edges go.
    What is then still larger is ordered level by level.
    """
    rest = cut(edges.select("src", "dst").distinct())
    size, aside = rest.count(), []
    while size > SMALL_EDGES:
        inner = cut(rest.join(rest.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi").select("src", "dst"))
        left = inner.count()
        if left * 2 > size:
            break
        aside.append((rest, inner))
        rest, size = inner, left
    if size <= SMALL_EDGES:
        kind = dict(rest.dtypes)["src"]
        levels = rest.groupBy(F.lit(0).alias("all")).applyInPandas(lambda part: _levels(part), f"node {kind}, level int")
        levels = cut(levels) if aside else levels
    else:
        levels = _level_by_level(rest)
    for outer, inner in reversed(aside):
        placed = levels.withColumn("placed", F.lit(True))
        # a source of an edge that is in no inner edge has no edge in
        above = outer.select(F.col("src").alias("node")).distinct().join(placed.hint("merge"), "node", "left").select("node", F.when(F.col("placed"), F.col("level")).otherwise(0).alias("level"))
        above = cut(above)
        ends = outer.join(inner.select("dst").distinct().hint("merge"), "dst", "left_anti").join(above.withColumnRenamed("node", "src").hint("merge"), "src")
        below = ends.groupBy(F.col("dst").alias("node")).agg(F.when(F.count("level") == F.count("*"), F.max("level") + 1).alias("level"))
        levels = cut(above.unionByName(below))
    return levels


def _level_by_level(rest: DataFrame) -> DataFrame:
    """``topological_levels`` of a stored table of distinct edges, in a round for each level."""
    nodes = cut(nodes_of(rest))
    done: list[DataFrame] = []
    while True:
        left = nodes if not done else nodes.join(_union(done), "node", "left_anti")
        ready = cut(left.join(rest.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(len(done))))
        if ready.isEmpty():
            return _union([*done, left.withColumn("level", F.lit(None).cast("int"))])
        done.append(ready)
        rest = cut(rest.join(ready.select(F.col("node").alias("src")), "src", "left_anti"))


def call_chain(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, step, node): following the least neighbour for ``depth`` steps, without coming back to a node."""
    first = edges.groupBy("src").agg(F.min("dst").alias("next"))
    now = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("seen"))
    out = []
    for step in range(1, depth + 1):
        now = now.join(first, now["at"] == first["src"]).filter(~F.array_contains("seen", F.col("next")))
        now = now.select("start", F.col("next").alias("at"), F.array_append("seen", F.col("next")).alias("seen"))
        out.append(now.select("start", F.lit(step).alias("step"), F.col("at").alias("node")))
    return _union(out)


def module_graph(edges: DataFrame, module_of) -> DataFrame:
    """(src_module, dst_module, weight) between different modules; ``module_of`` maps a node column to its module."""
    rows = edges.select(module_of(F.col("src")).alias("src_module"), module_of(F.col("dst")).alias("dst_module"))
    return rows.filter("src_module != dst_module").groupBy("src_module", "dst_module").agg(F.count("*").alias("weight"))


def limited_call_graph(edges: DataFrame, max_nodes: int, max_edges: int) -> DataFrame:
    """Edges between the first ``max_nodes`` nodes, the first ``max_edges`` of them, both in id order."""
    kept = nodes_of(edges).orderBy("node").limit(max_nodes)
    inside = edges.join(kept.withColumnRenamed("node", "src"), "src").join(kept.withColumnRenamed("node", "dst"), "dst")
    return inside.select("src", "dst").distinct().orderBy("src", "dst").limit(max_edges)


def text_references(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, line, name, symbol_id): identifiers in code lines of files (path, content) that name a symbol (symbol_id, file, name).

    Import lines, comments and definitions of the same name on the line don't
    count; of several symbols the same file's, else the least id, is meant.
    """
    rows = files.select(F.col("path").alias("file"), F.posexplode(F.split("content", r"\r?\n")).alias("at", "text"))
    code = rows.filter(~F.col("text").rlike(r"^\s*(?://|#|\*|/\*|import\b|from\b|use\b|package\b)"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))
    used = code.select("file", (F.col("at") + 1).alias("line"), "text", F.explode(words).alias("name"))
    defines = r"(?:def|fn|func|function|class|struct|enum|trait|interface|type|const|let|var)\s+"
    used = used.filter(~F.contains(F.regexp_replace("text", defines, "\u0001"), F.concat(F.lit("\u0001"), F.col("name"))))
    named = symbols.select("symbol_id", F.col("file").alias("where"), "name")
    best = used.join(named, "name").groupBy("file", "line", "name").agg(
        F.min(F.struct((F.col("where") != F.col("file")).alias("far"), "symbol_id")).alias("m")
    )
    return best.select("file", "line", "name", F.col("m.symbol_id").alias("symbol_id"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(caller_id, callee_id) of calls (caller_id, file, name): a symbol (symbol_id, file, name) of the same file,
    else of an imported file (file, imported), else the first by id.

    Symbols are reduced to the first of each file and name, and of each name,
    and calls to distinct files and names, before they meet; so no call meets
    all symbols of its name.
    """
    least = F.struct(F.min("callee_id").alias("callee_id"))
    firsts = symbols.filter("name IS NOT NULL").groupBy("name", F.col("file").alias("callee_file")).agg(F.min("symbol_id").alias("callee_id"))
    anywhere = firsts.groupBy("name").agg(least.alias("far"))
    asked = calls.filter("name IS NOT NULL").select("file", "name").distinct()
    own = firsts.select(F.col("callee_file").alias("file"), "name", F.struct("callee_id").alias("same"))
    reached = asked.join(imports.select("file", F.col("imported").alias("callee_file")).distinct(), "file").join(firsts, ["name", "callee_file"])
    near = reached.groupBy("file", "name").agg(least.alias("near"))
    found = asked.join(anywhere, "name").join(own, ["file", "name"], "left").join(near, ["file", "name"], "left")
    best = found.select(F.col("file").alias("asked_file"), F.col("name").alias("asked_name"), F.coalesce("same", "near", "far").alias("m"))
    meant = calls.join(best, F.col("file").eqNullSafe(F.col("asked_file")) & (F.col("name") == F.col("asked_name")))
    return meant.select("caller_id", F.col("m.callee_id").alias("callee_id")).distinct()


def innermost_span(points: DataFrame, spans: DataFrame, bin_size: int = 64) -> DataFrame:
    """(file, line, symbol_id) of each point (file, line): the shortest of the spans (file, start, end, symbol_id) around it.

    A range join by bins: spans are put into each bin they touch, points into one, so it is an equi-join.
    """
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))))
    asked = points.withColumn("bin", F.floor(F.col("line") / bin_size))
    hits = asked.join(binned, ["file", "bin"]).filter(F.col("line").between(F.col("start"), F.col("end")))
    best = hits.groupBy("file", "line").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("n"), F.col("start"), F.col("symbol_id"))).alias("m"))
    return best.select("file", "line", F.col("m.symbol_id").alias("symbol_id"))
