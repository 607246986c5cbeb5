"""Compositions on small code bases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sievework.functions import shared
from sievework.operators import chunking, context, corpus, graph, rank, state, transform
from sievework.plans import embed, queries, repo_map
from sievework.sources import code
from tests.test_core import PYTHON, one, rows


@pytest.fixture(scope="module")
def files(spark):
    data = [("src/m.py", "python", PYTHON), ("lib/h.py", "python", "def helper(v):\n    token = 'abcdefghijklmnopqrstuvwx'\n    return v\n")]
    return spark.createDataFrame(data, "path string, language string, content string").cache()


def test_embed(spark, files, tmp_path):
    made = embed.chunks(files).cache()
    assert {r.name for r in made.collect()} == {"Base", "run", "_hidden", "helper"}
    assert not made.filter(F.contains("content", F.lit("abcdefghijklmnopqrstuvwx"))).count()
    state.save_manifest(made.select("location_key", "full_hash"), str(tmp_path / "m"))
    old = state.load_manifest(spark, str(tmp_path / "m"))
    assert {r.status for r in embed.difference(made, old).collect()} == {"unchanged"}
    changed = embed.chunks(files.withColumn("content", F.replace("content", F.lit("return v"), F.lit("return 1"))))
    assert rows(embed.difference(changed, old).groupBy("status").count()) == [("modified", 1), ("unchanged", 3)]
    spark.createDataFrame([("x", "y")], old.schema).write.mode("append").parquet(str(tmp_path / "m/entries"))
    with pytest.raises(ValueError):
        state.load_manifest(spark, str(tmp_path / "m"))


def test_repo_map(spark, files):
    symbols = code.parse_symbols(files).filter("kind != 'import'").withColumn("symbol_id", F.concat_ws(":", "file", "name"))
    edges = spark.createDataFrame([("src/m.py:run", "lib/h.py:helper")], "src string, dst string")
    sizes = symbols.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("symbols"))
    made = repo_map.repo_map(symbols, edges, sizes)
    assert made["symbols"].first().name in ("helper", "run") and made["symbols"].count() == 4
    assert rows(made["module_edges"]) == [("src", "lib", 1)]
    assert rows(made["modules"]) == [("lib", 1, 1), ("src", 1, 3)]
    assert made["files"].count() == 2
    assert {r.name for r in rank.exported_symbols(symbols).collect()} == {"Base", "helper"}


def test_references_and_limits(spark, files):
    symbols = spark.createDataFrame([(1, "lib/h.py", "helper"), (2, "src/m.py", "rest"), (3, "src/m.py", "helper")], "symbol_id long, file string, name string")
    found = graph.text_references(files, symbols)
    assert ("src/m.py", 9, "helper", 3) in rows(found) and not found.filter("file = 'lib/h.py'").count()
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 9)], "src long, dst long")
    assert rows(graph.limited_call_graph(edges, 3, 1)) == [(1, 2)]
    accepted, rejected = corpus.within_limits(files, max_line=36)
    assert (accepted.count(), rejected.count()) == (1, 1) and rejected.first().reason == "line_length"
    tree = corpus.token_tree(spark.createDataFrame([("a/b/c", 3), ("a/d", 4), ("e", 5)], "path string, tokens long"))
    assert rows(tree) == [("a", 2, 7), ("a/b", 1, 3)]
    kept, factor = corpus.sample_share(spark.range(1000).withColumnRenamed("id", "k"), "k", 20)
    assert 150 < kept.count() < 250 and abs(kept.count() * factor - 1000) < 1e-6
    done = spark.createDataFrame([("src/m.py",)], "path string")
    assert state.pending(files, done).first().path == "lib/h.py"


@pytest.mark.parametrize("old, new, expected", [
    ("def f(a, b: dict[str, int]) -> int:", "def f(a, b: dict[str, int]) -> int:", []),
    ("def f(a)", "def f(a, b)", ["parameter_added"]), ("def f(a, b)", "def f(b)", ["parameter_removed"]),
    ("fn f(a: u8) -> u8 {", "fn f(a: u16) -> u16 {", ["parameter_changed", "return_type_changed"]),
])
def test_signature_changes(spark, old, new, expected):
    assert one(spark, rank.signature_changes(F.col("a"), F.col("b")), a=old, b=new) == expected


def test_every_query_reads_whole_tables():
    """No query takes a subset of its rows, but for those whose feature it is: top lists, samples, stated query sets, roles of rows in a fixture."""
    assert not [n for n in queries.QUERIES if n.endswith("_whole")]


def test_supply_graph(spark, tmp_path):
    """Items of small quantity and discount make edges too."""
    put = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("orders", [(1, 10), (2, 11)], "o_orderkey long, o_custkey long")
    put("supplier", [(5, 4), (6, 7)], "s_suppkey long, s_nationkey int")
    put("lineitem", [(1, 5, 1.0, 0.0), (2, 6, 50.0, 0.1)], "l_orderkey long, l_suppkey long, l_quantity double, l_discount double")
    nodes = {10, 11, 1_000_000_005, 1_000_000_006, 2_000_000_004, 2_000_000_007}
    assert {r[0] for r in rows(queries.QUERIES["pagerank"](spark, str(tmp_path)))} == nodes
    assert {r[0] for r in rows(queries.QUERIES["file_importance"](spark, str(tmp_path)))} == nodes


def brute_pagerank(edges, rounds, dangling, damping=0.85):
    nodes = sorted({n for e in edges for n in e})
    rank = {n: 1 / len(nodes) for n in nodes}
    outs = {n: [b for a, b in edges if a == n] for n in nodes}
    for _ in range(rounds):
        lost = sum(rank[n] for n in nodes if not outs[n]) if dangling else 0.0
        new = {n: (1 - damping) / len(nodes) + damping * lost / len(nodes) for n in nodes}
        for a in nodes:
            for b in outs[a]:
                new[b] += damping * rank[a] / len(outs[a])
        rank = new
    return rank


@pytest.mark.parametrize("dangling", [True, False])
def test_pagerank_against_brute_force(spark, dangling):
    rng = random.Random(1)
    edges = [(rng.randrange(12), rng.randrange(15)) for _ in range(40)]
    found = graph.pagerank(spark.createDataFrame(edges, "src long, dst long"), iterations=9, dangling=dangling)
    expected = brute_pagerank(edges, 9, dangling)
    assert {r.node: round(r["rank"], 12) for r in found.collect()} == {n: round(v, 12) for n, v in expected.items()}
    stopped = graph.pagerank(spark.createDataFrame(edges, "src long, dst long"), iterations=500, tolerance=1e-9)
    settled = brute_pagerank(edges, 300, True)
    assert all(abs(r["rank"] - settled[r.node]) < 1e-8 for r in stopped.collect())


def test_repetitive_texts():
    fold = transform.compress_repeats
    assert fold("ab " * 100) == "ab ab ab ab ab\n/* ... pattern repeated 100 times (showing 5) ... */"
    assert fold("ab " * 100 + "the end", 0.02) == "ab ab\n/* ... pattern repeated 100 times (showing 2) ... */\nthe end"
    assert fold("é" * 300, 0.001) == "é\n/* ... pattern repeated 300 times (showing 1) ... */"
    assert fold(" " * 300) is None and fold("ab " * 20) is None
    lines = ["start", *["same line here"] * 30, "middle", *["same line here"], "end"]
    expected = "start\nsame line here\n/* ... above line repeated 30 times ... */\nmiddle\nsame line here\nend"
    assert fold("\n".join(lines)) == expected
    assert fold("\n".join(f"line {i} of many" for i in range(50))) is None


def test_dependency_chunks(spark):
    """A full chunk isn't ended before a file that imports one of its files; files on cycles come last."""
    files = spark.createDataFrame([("a", 40), ("b", 40), ("c", 40), ("d", 40), ("x", 1), ("y", 1)], "path string, tokens long")
    imports = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "path string, resolved string")
    found = {r.path: r.chunk for r in chunking.dependency_chunks(files, imports, 50).collect()}
    assert found == {"a": 0, "d": 1, "b": 2, "c": 2, "x": 3, "y": 3}


def test_shared_folder(spark):
    class Cluster:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "spark://m:7077"})()

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        with pytest.raises(ValueError):
            shared.shared_dir(Cluster())
    assert shared.shared_path(spark, "x") != shared.shared_path(spark, "x")


def test_levels_of_large_graphs(spark, monkeypatch):
    """Edges into nodes without edges out are put aside, so a wide graph takes few tables; nodes on or behind cycles stay null."""
    tree = [(n // 3, n) for n in range(3, 2000)] + [(1, 1500), (5000, 5001)]
    cyclic = [(9001, 9002), (9002, 9001), (9002, 9003), (1, 9003), (9003, 9004), (2, 9005)]
    expected = dict.fromkeys([9001, 9002, 9003, 9004])
    for src, dst in sorted(tree, key=lambda e: e[1]):
        expected.setdefault(src, 0)
        expected[dst] = max(expected.get(dst, 0), expected[src] + 1)
    expected[9005] = 1
    tables, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: tables.append(1) or real(df))
    for small, most in ((100, 13), (0, 80)):
        monkeypatch.setattr(graph, "SMALL_EDGES", small)
        tables.clear()
        found = graph.topological_levels(spark.createDataFrame(tree + cyclic + [(1, 3)], "src long, dst long")).collect()
        assert {r.node: r.level for r in found} == expected and len(found) == len(expected)
        assert len(tables) <= most


def test_dependency_chunks_of_one_chain(spark):
    """A chunk may hold all files: each imports the one before."""
    n = 60_000
    files = spark.range(n).select(F.format_string("f%06d", "id").alias("path"), F.lit(1).cast("long").alias("tokens"))
    imports = files.withColumn("resolved", F.format_string("f%06d", F.substring("path", 2, 6).cast("int") - 1)).filter("path != 'f000000'")
    start = time.perf_counter()
    found = chunking.dependency_chunks(files, imports.select("path", "resolved"), 50)
    assert found.agg(F.max("chunk"), F.count("*")).first() == (0, n)
    assert time.perf_counter() - start < 30


def brute_closure(edges, max_depth=None):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for start in after:
        found, now, depth = {}, set(after[start]), 1
        while now and (max_depth is None or depth <= max_depth):
            found.update(dict.fromkeys(now, depth))
            now = {c for b in now if b is not None for c in after.get(b, ())} - set(found)
            depth += 1
        out |= {(start, end, d) for end, d in found.items()}
    return out


@pytest.mark.parametrize("small", [60, 3])
def test_closure_of_many_sources(spark, monkeypatch, small):
    """Edges from nodes without edges in are no later steps: with few others there are no rounds, however many edges there are."""
    rng = random.Random(2)
    inner = [(n, rng.randrange(12)) for n in range(12)] * 2 + [(3, 3), (4, None), (20, 21), (21, 22)]
    edges = inner + [(100 + n, rng.randrange(12)) for n in range(400)] + [(100 + 5 * n, rng.choice([2, 5, 20])) for n in range(80)] + [(None, 4)]
    tables, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: tables.append(1) or real(df))
    monkeypatch.setattr(graph, "SMALL_EDGES", small)
    monkeypatch.setattr(graph, "SEARCH_ROWS", 50)
    for most in (None, 2):
        tables.clear()
        found = [tuple(r) for r in graph.closure(spark.createDataFrame(edges, "src long, dst long"), most).collect()]
        assert len(found) == len(set(found)) and set(found) == brute_closure(edges, most)
        assert small == 3 or len(tables) == 2
    assert graph.closure(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_resolve_calls_against_brute_force(spark):
    """Same file, then imported files, then all, each by least id; calls and symbols of one name don't meet in pairs."""
    rng = random.Random(3)
    pick = lambda n: rng.choice([None, *"abcdef"[:n]])
    symbols = [(i, pick(6), pick(3)) for i in range(60)] + [(None, "a", "a")]
    calls = [(rng.randrange(30), pick(6), rng.choice([None, *"abcz"])) for _ in range(90)]
    imports = [(pick(6), pick(6)) for _ in range(9)]
    expected = set()
    for caller, file, name in calls:
        named = [(0 if f == file and f else 1 if f and file and (file, f) in imports else 2, i) for i, f, n in symbols if n and n == name and i is not None]
        if named:
            expected.add((caller, min(named)[1]))
    made = [spark.createDataFrame(d, s) for d, s in ((calls, "caller_id long, file string, name string"), (symbols, "symbol_id long, file string, name string"), (imports, "file string, imported string"))]
    found = [tuple(r) for r in graph.resolve_calls(*made).collect()]
    assert set(found) == expected and len(found) == len(expected)
    many = spark.range(60_000).select(F.col("id").alias("symbol_id"), F.concat(F.lit("f"), F.col("id") % 50).alias("file"), F.lit("n").alias("name"))
    start = time.perf_counter()
    found = graph.resolve_calls(many.withColumnRenamed("symbol_id", "caller_id"), many, made[2])
    assert found.agg(F.count("*"), F.max("callee_id")).first() == (60_000, 49)
    assert time.perf_counter() - start < 30


def brute_parents(parts):
    least = lambda *v: tuple((x is not None, 0 if x is None else x) for x in v)
    out = {}
    for own, file, _, parent, a, b in parts:
        for other, place, name, _, s, e in parts:
            if own is None or other is None or file is None or parent is None or (place, name) != (file, parent) or own == other:
                continue
            known = None not in (a, b, s, e)
            tier = 0 if known and s <= a and b <= e else 1 if known and s <= b and a <= e else 2
            key = (tier, *least(None if None in (s, e) else e - s, s, e), other)
            out[own] = min(out.get(own, key), key)
    return {own: key[-1] for own, key in out.items()}


@pytest.mark.parametrize("block", [4, 1000])
def test_link_parents_against_brute_force(spark, monkeypatch, block):
    rng = random.Random(4)
    line = lambda: rng.choice([None, *range(12)])
    spans = [(line(), line()) for _ in range(30)] + [(a := rng.randrange(60), a + rng.randrange(15)) for _ in range(250)]
    parts = [(i, rng.choice([None, "f", "g"]), rng.choice([None, *"abc"]), rng.choice([None, *"abcd"]), *span) for i, span in enumerate(spans)]
    parts += [(7, *parts[0][1:4], 3, 9), (None, "f", "a", "a", 1, 2), (900, "h", "x", "x", 1, 2)]
    monkeypatch.setattr(context, "BLOCK", block)
    rng.shuffle(parts)
    found = context.link_parents(spark.createDataFrame(parts, "id long, file string, name string, parent string, start_line int, end_line int")).collect()
    assert {r.id: r.parent_id for r in found} == brute_parents(parts) and len(found) == len({r.id for r in found})


def test_link_parents_of_one_name(spark):
    """The parts of one file and name don't meet in pairs."""
    n = 60_000
    parts = spark.range(n).selectExpr("id", "'f' AS file", "'a' AS name", "'a' AS parent", "CAST(id AS int) AS start_line", f"CAST({2 * n} - id AS int) AS end_line")
    start = time.perf_counter()
    found = context.link_parents(parts)
    assert found.agg(F.count("*"), F.count_if(F.col("parent_id") == F.col("id") - 1)).first() == (n, n - 1)
    assert time.perf_counter() - start < 40


def test_tests_by_name_without_broadcast(spark):
    """No side goes through the driver, however small it is thought to be."""
    sources = spark.range(2000).select(F.format_string("src/m%d.py", "id").alias("path"))
    tests = spark.range(2000).select(F.format_string("tests/m%dx.py", "id").alias("path"))
    found = context.tests_by_name(sources, tests)
    assert found.filter("path = 'src/m12.py'").count() == 111  # m12, m120 to m129, m1200 to m1299
    assert found.count() == sum(1 for n in range(2000) for k in range(1, len(str(n)) + 1) if str(n)[:k] == str(int(str(n)[:k])))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
