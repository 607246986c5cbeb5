"""Index, contexts, budgets and state on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import context, corpus, diff_output, graph, index, rank, state, transform
from sievework.plans import embed
from sievework.sources import code, documents, scan
from sievework.streaming import watch
from tests.test_core import one, rows


def put(spark, data, schema):
    return spark.createDataFrame(data, schema)


FILES = [
    ("src/a.py", "python", "from lib.b import help_me\n\nclass A(B):\n    def run(self, x: int) -> str:\n        return help_me(x)\n\ndef _own():\n    pass\n"),
    ("lib/b.py", "python", "import os\n\ndef help_me(v, *more, key=None):\n    # why\n    return v\n"),
    ("bad.py", "python", "def broken(:\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    return put(spark, FILES, "path string, language string, content string").cache()


def test_index_is_saved_loaded_and_deleted(spark, files, tmp_path):
    built = index.build_index(files)
    path = str(tmp_path / "index")
    index.save_index(built, path)
    loaded = index.load_index(spark, path)
    assert {n: rows(t) for n, t in loaded.items()} == {n: rows(t) for n, t in built.items()}
    assert {r.name for r in loaded["symbols"].collect()} == {"A", "run", "_own", "help_me"}
    run = loaded["symbols"].filter("name = 'run'").first()
    assert run.parent_id == "src/a.py:3:A" and run.signature == "def run(self, x: int) -> str"
    assert index.index_bytes(spark, path) > 1000
    assert index.delete_index(spark, path) and not index.delete_index(spark, path)


def test_symbol_queries(spark):
    symbols = put(spark, [(1, "b.py", "f", 2), (2, "b.py", "f", 2), (3, "a.py", "f", 9), (4, "c.py", "g", 1)], "symbol_id long, file string, name string, start_line int")
    edges = put(spark, [(4, 1, "call"), (4, 3, "call"), (1, 4, "call"), (4, 1, "reference")], "src long, dst long, edge_type string")
    assert [(r.file, r.start_line) for r in index.find_symbol(symbols, "f").collect()] == [("a.py", 9), ("b.py", 2)]
    assert [r.symbol_id for r in index.callers_of(symbols, edges, "f").collect()] == [4]
    assert [r.symbol_id for r in index.callees_of(symbols, edges, "f").collect()] == [4]
    assert rows(index.references_of(symbols, edges, "f")) == [(4, "call"), (4, "reference")]
    assert rows(index.importers_of(put(spark, [("x", "y", "import"), ("z", "y", "call")], "src string, dst string, edge_type string"), "y")) == [("x",)]


def brute_components(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for _ in nodes:
        reach = {n: r | {x for m in r for x in reach[m]} for n, r in reach.items()}
    out = []
    for n in nodes:
        own = {m for m in nodes if m in reach[n] and n in reach[m]} | {n}
        if len(own) > 1:
            out.append((n, min(own)))
    return sorted(out)


@pytest.mark.parametrize("small", [0, 500_000])
def test_cycles_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL_EDGES", small)
    rng = random.Random(8)
    edges = sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(34)})
    found = graph.cycles(put(spark, edges, "src long, dst long"))
    assert sorted(map(tuple, found.select("node", "component").collect())) == brute_components(edges)
    assert graph.cycles(put(spark, [("a", "b"), ("b", "c")], "src string, dst string")).isEmpty()


def test_cycle_paths(spark):
    edges = put(spark, [("b", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e")], "src string, dst string")
    assert sorted(r.cycle for r in index.cycle_paths(edges).collect()) == [["a", "b"], ["a", "b", "c"]]


def test_lazy_context_and_impact(spark, files):
    changed = put(spark, [("src/a.py",), ("gone.py",)], "path string")
    assert rows(index.lazy_context(files, changed)) == [("lib/b.py", 1), ("src/a.py", 0)]
    edges = put(spark, [("u", "c", "import"), ("t/test_u.py", "u", "import")], "src string, dst string, edge_type string")
    found = index.context_impact({"edges": edges}, put(spark, [("c",)], "path string"))
    assert rows(found.select("path", "level", "is_test")) == [("c", 0, False), ("t/test_u.py", 2, True), ("u", 1, False)]


def test_context_budget(spark):
    data = [("c", "changed", 1.0, 50), ("d1", "dependent", 0.9, 40), ("d2", "dependent", 0.8, 30), ("d3", "dependent", 0.7, 10), ("t", "test", 1.0, 5), ("t2", "test", 0.5, 1)]
    files = put(spark, data, "path string, role string, relevance double, tokens long")
    kept = lambda budget: sorted(r.path for r in index.context_budget(files, budget).collect())
    assert kept(100) == ["c", "d1", "d3"] and kept(106) == ["c", "d1", "d3", "t", "t2"]
    assert kept(0) == ["c"] and kept(1000) == sorted(d[0] for d in data)


def test_diff_budget(spark):
    data = [("a", "dependent", 0.5, 0, "dependent symbol x", 30), ("a", "dependent", 0.5, 1, "changed symbol y", 90), ("b", "test", 0.7, 0, "other", 20), ("b", "test", 0.7, 1, "other", 10)]
    snippets = put(spark, data, "path string, role string, relevance double, ord int, reason string, tokens long")
    kept = lambda budget: rows(index.diff_budget(snippets, 10, budget).select("path", "ord"))
    assert kept(0) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    assert kept(75) == [("a", 0), ("b", 0), ("b", 1)]
    assert kept(100) == [("a", 1)]


def test_failures_of_one_group_are_isolated(spark):
    import pandas as pd

    def run(part):
        if part["v"].iloc[0] < 0:
            raise ValueError("negative")
        return pd.DataFrame({"n": [len(part)], "total": [int(part["v"].sum())]})

    good, bad = index.isolated(put(spark, [("a", 1), ("a", 2), ("b", -1), ("c", 5)], "repo string, v long"), "repo", run, "n long, total long")
    assert rows(good) == [("a", 2, 3), ("c", 1, 5)] and rows(bad) == [("b", "ValueError: negative")]


def test_batch_of_repositories(spark):
    data = [("r1", *FILES[0]), ("r2", *FILES[0]), ("r2", *FILES[1]), ("r3", "x.py", "python", None), ("r3", *FILES[1])]
    chunks, failures = embed.batch(put(spark, data, "repo string, path string, language string, content string"))
    assert {(r.repo, r["file"], r.name) for r in chunks.collect()} >= {("r1", "src/a.py", "run"), ("r2", "lib/b.py", "help_me")}
    assert {r.repo for r in chunks.collect()} == {"r1", "r2"} and [r.repo for r in failures.collect()] == ["r3"]
    keys = [r.location_key for r in chunks.collect()]
    assert len(keys) == len(set(keys))


# --- paths


def test_default_ignores(spark):
    paths = ["node_modules/a/b.js", "src/node_modules/x", "a/b.png", "src/a.test.ts", "x/test/a", "docs/a", "src/docs/a", ".env", ".env.local", "dist/x", "src/main.rs"]
    frame = put(spark, [(p,) for p in paths], "path string")
    ignored = lambda **more: {r.path for r in frame.filter(corpus.is_ignored(F.col("path"), **more)).collect()}
    base = {"node_modules/a/b.js", "a/b.png", ".env", ".env.local", "dist/x"}
    assert ignored() == base
    assert ignored(tests=False) == base | {"src/a.test.ts", "x/test/a"} and ignored(docs=False) == base | {"docs/a"}


def test_gitignore_rules(spark):
    paths = ["a.log", "x/a.log", "x/keep.log", "build/o", "x/build/o", "doc/a.txt", "x/doc/a.txt", "tmp", "tmp/x", "a/b/c/d.q", "foo/z", "x/foo/z"]
    rules = [("", 0, "*.log"), ("x", 0, "!keep.log"), ("", 1, "/build/"), ("", 2, "doc/*.txt"), ("", 3, "tmp/"), ("", 4, "a/**/d.q"), ("", 5, "# foo"), ("", 6, ""), ("x", 1, "/foo")]
    left = corpus.gitignored(put(spark, [(p,) for p in paths], "path string"), put(spark, rules, "folder string, ord int, pattern string"))
    assert sorted(r.path for r in left.collect()) == sorted(["x/keep.log", "x/build/o", "x/doc/a.txt", "tmp", "foo/z"])


@pytest.mark.parametrize("path, fast, priority", [
    ("src/main.rs", -5000, 100.0), ("a/package.json", -2000, 90.0), ("a/lib/x.rs", 200, 80.0), ("a/api/x.rs", 400, 75.0), ("a/src/x.rs", 0, 60.0),
    ("a/tests/x.rs", 3000, 20.0), ("a/utils/x.rs", 1000, 30.0), ("notes.md", 2500, 10.0), ("x.rs", 1000, 50.0), ("a/vendor/x.rs", 4000, 50.0),
])
def test_path_ranks(spark, path, fast, priority):
    assert one(spark, rank.fast_rank(F.col("p")), p=path) == fast
    assert one(spark, rank.chunk_priority(F.col("p")), p=path) == priority


@pytest.mark.parametrize("path, language, module", [
    ("src/auth/jwt.rs", "rust", "auth::jwt"), ("src/lib.rs", "rust", ""), ("src/auth/mod.rs", "rust", "auth"), ("src/auth/jwt.py", "python", "auth.jwt"),
    ("src/auth/__init__.py", "python", "auth"), ("x/site-packages/a/b.py", "python", "a.b"), ("pkg/src/a/b.py", "python", "a.b"), ("src/auth/jwt.ts", "typescript", "auth/jwt"),
    ("src/auth/index.tsx", "tsx", "auth"), ("index.js", "javascript", ""), ("src/main/java/com/foo/Bar.java", "java", "com.foo"), ("Bar.java", "java", ""),
    ("internal/auth/jwt.go", "go", "auth"), ("main.go", "go", "main"), ("lib/a/b.rb", "ruby", "a::b"),
])
def test_module_paths(spark, path, language, module):
    from sievework.functions import text as X

    assert one(spark, X.module_path(F.col("p"), F.col("l")), p=path, l=language) == module


def test_test_predicates(spark):
    paths = {"a/tests/x.py": (True, True), "a/spec/x.rb": (True, False), "test_x.py": (True, False), "x_test.go": (True, False), "contest.py": (False, False), "a\\tests\\x.py": (True, True)}
    for path, (chunked, streamed) in paths.items():
        assert one(spark, context.is_chunked_test(F.col("p")), p=path) == chunked and one(spark, context.is_streamed_test(F.col("p")), p=path) == streamed


# --- texts


def test_truncation_strategies():
    text = "def a():\n    pass\n\ndef b():\n    return 1\n\n@x\ndef c():\n    return 2\n" * 3
    hard, line, semantic = (transform.truncate_content(text, 20, strategy=s) for s in transform.STRATEGIES)
    assert all(t.endswith("\n\n... [truncated]") for t in (hard, line, semantic))
    assert text.startswith(hard.removesuffix(transform.TRUNCATED)) and len(semantic) <= len(line) <= len(hard)
    assert line.removesuffix(transform.TRUNCATED).endswith("\n") and text[len(semantic.removesuffix(transform.TRUNCATED)) :].startswith(("def ", "@"))
    assert transform.truncate_content("short", 100) == "short" and transform.truncate_content("", 1) == ""


def test_output_truncation():
    out = "".join(f"<file>{'word ' * 20}{i}</file>\n" for i in range(9))
    cut = transform.truncate_output(out, 60)
    assert cut.endswith("</file>\n\n<!-- Output truncated to fit token limit -->\n") and out.startswith(cut.split("\n\n<!--")[0])
    assert transform.truncate_output("plain words only here and on " * 30, 20).endswith("<!-- Output truncated to fit token limit -->\n")
    assert transform.truncate_output("fits", 20) == "fits"


def test_budget_makes_contents(spark):
    rows_ = [("a", 0.9, 500, "w " * 1000), ("b", 0.8, 5000, "x y\n" * 5000), ("c", 0.1, 5000, "z " * 5000), ("d", 0.05, 10, "tiny")]
    done = {r.path: r for r in corpus.truncated_to_budget(put(spark, rows_, "path string, importance double, tokens long, content string"), 2000).collect()}
    assert done["a"].content == rows_[0][3] and done["b"].content.endswith("... [truncated]") and done["b"].used == 500
    assert done["c"].content is None and done["d"].action == "drop"


def test_key_symbols(spark, files):
    found = {r.path: r.text for r in transform.key_symbols(files, code.parse_symbols(files)).collect()}
    assert found["src/a.py"] == "// class: A\nclass A(B)\n// function: _own\ndef _own()\n"
    assert found["lib/b.py"] == "// function: help_me\ndef help_me(v, *more, key=None)\n" and found["bad.py"] == "def broken(:\n"
    near = {r.path: r.text for r in transform.key_symbols(files, code.parse_symbols(files), around=1).collect()}
    assert near["lib/b.py"] == "// function: help_me\n\ndef help_me(v, *more, key=None):\n    # why\n"


def test_types_and_branches(spark, files):
    found = rows(code.type_signatures(code.parse_symbols(files)).filter("name = 'run'").select("parameter", "type", "ord"))
    assert found == [("return", "str", -1), ("self", None, 0), ("x", "int", 1)]
    java = put(spark, [("f", "m", 1, "method", "int m(final String a, int[] b)")], "file string, name string, start_line int, kind string, signature string")
    assert rows(code.type_signatures(java).filter("ord >= 0").select("parameter", "type")) == [("a", "final String"), ("b", "int[]")]
    for text, language, n in [("if a and b:\n  pass # or\nelif c: x = 'if'\n", "python", 4), ("if (a && b) { x ? y : z } // if", "javascript", 4), ("x", "cobol", None)]:
        assert one(spark, code.branch_count(F.col("t"), F.col("l")), t=text, l=language) == n


def test_breaking_changes(spark):
    schema = "name string, file string, signature string, visibility string, extends string"
    old = put(spark, [("f", "a", "def f(a, b)", "public", None), ("g", "a", "def g()", "public", None), ("h", "a", "def h(x)", "private", None), ("k", "a", None, "public", None)], schema)
    new = put(spark, [("f", "b", "async def f(c, b, d) -> int", "public", "B"), ("h", "a", "def h()", "private", None), ("k", "a", None, "protected", None)], schema)
    found = rank.breaking_changes(old, new)
    assert rows(found.select("name", "change")) == sorted([
        ("f", "moved"), ("f", "parameter_added"), ("f", "async_changed"), ("f", "type_constraint_changed"), ("f", "parameter_type_changed"), ("g", "removed"), ("k", "visibility_reduced"),
    ], key=repr)
    summary = rank.breaking_summary(found).first()
    assert (summary.total, summary.critical, summary.high, summary.medium, summary.symbols) == (7, 2, 3, 2, 3)


def test_contexts_without_rows(spark):
    frame = put(spark, [("low", "d", 0, 0, 0, 0, 0, *[None] * 6)], diff_output.CONTEXT)
    for form in diff_output.FORMATS:
        text = diff_output.format_context(frame, form).first().text
        assert "low" in text and "null" not in text.lower().replace('"diff_content":null', "")


# --- state


def test_settings_and_checkpoints(spark, tmp_path):
    assert state.settings_match({"a": 1, "b": [2]}, {"b": [2], "a": 1}) and not state.settings_match({"a": 1}, {"a": 2})
    manifest = put(spark, [("k", "h")], "location_key string, full_hash string")
    state.save_manifest(manifest, str(tmp_path / "m"), {"limit": 1})
    assert rows(state.load_manifest(spark, str(tmp_path / "m"), {"limit": 1})) == [("k", "h")]
    with pytest.raises(ValueError, match="other settings"):
        state.load_manifest(spark, str(tmp_path / "m"), {"limit": 2})
    done = put(spark, [("a",), ("b",)], "path string")
    state.save_checkpoint(spark, str(tmp_path / "c"), "chunking", done, {"limit": 1})
    phase, processed = state.load_checkpoint(spark, str(tmp_path / "c"), {"limit": 1})
    assert phase == "chunking" and rows(processed) == [("a",), ("b",)]
    with pytest.raises(ValueError, match="other settings"):
        state.load_checkpoint(spark, str(tmp_path / "c"))
    done.limit(1).write.mode("append").parquet(str(tmp_path / "c/processed"))
    put(spark, [("z",)], "path string").write.mode("append").parquet(str(tmp_path / "c/processed"))
    with pytest.raises(ValueError, match="damaged"):
        state.load_checkpoint(spark, str(tmp_path / "c"), {"limit": 1})
    with pytest.raises(ValueError, match="phase"):
        state.save_checkpoint(spark, str(tmp_path / "c"), "nowhere", done)


def test_audit_chain(spark):
    events = put(spark, [("l", 2, "data_exported", "x"), ("l", 1, "scan_started", None), ("l", 3, "unknown", ""), ("m", 1, "scan_failed", "e")], "log string, seq long, event string, detail string")
    chain = state.chained_audit(events, "log").cache()
    assert chain.count() == 3 and state.verify_chain(chain, ["log"]).isEmpty()
    tampered = chain.withColumn("hash", F.when(F.col("seq") == 1, "0").otherwise(F.col("hash")))
    assert rows(state.verify_chain(tampered, ["log"]).select("log", "seq")) == [("l", 2)]


def test_stream_with_deletes(spark, tmp_path):
    schema = "doc_id long, text string, gone boolean"
    seen = []
    for number, batch in enumerate([[(1, "a", False), (2, "b", False)], [(1, "c", False), (2, None, True), (3, None, True)], [(2, "b", False)]]):
        put(spark, batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = watch.watch_documents(spark, str(tmp_path / "in"), schema)
        query = watch.keep_manifest(stream, str(tmp_path / "m"), str(tmp_path / "ck"), lambda d, n: seen.append((n, rows(d.select("location_key", "status")))), "gone")
        query.awaitTermination(120)
        assert watch.totals(query)["error"] is None and not watch.totals(query)["active"]
        watch.cancel(query)
        assert number + 1 >= len(seen)
    assert [s for _, s in seen] == [[("1", "added"), ("2", "added")], [("1", "modified"), ("2", "removed")], [("2", "added")]]
    assert sorted(r.location_key for r in watch.latest_manifest(spark, str(tmp_path / "m")).collect()) == ["1", "2"]


def test_streaming_embed(spark, files, tmp_path):
    files.write.parquet(str(tmp_path / "in"))
    watch.embed_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), batch_files=1).awaitTermination(240)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["file"], r.name) for r in found.collect()} == {(r["file"], r.name) for r in embed.chunks(files).collect()}


# --- scans


def test_scan_presets_and_pieces(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def a():\n    return 1\n" * 20)
    (tmp_path / "b.txt").write_text("words " * 50)
    (tmp_path / "c.png").write_bytes(b"\x89PNG")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("x")
    fast = {r.path: r for r in scan.scan(spark, str(tmp_path), "fast").collect()}
    accurate = {r.path: r for r in scan.scan(spark, str(tmp_path), "accurate").collect()}
    assert set(fast) == set(accurate) == {"src/a.py", "b.txt"} and "content" not in scan.scan(spark, str(tmp_path), "fast").columns
    assert accurate["src/a.py"].symbols == 20 and accurate["b.txt"].symbols == 0 and fast["b.txt"].tokens > 0
    assert "symbols" not in scan.scan(spark, str(tmp_path), "accurate", symbols=False).columns
    pieces = scan.file_pieces(spark, str(tmp_path / "src"), 100).collect()
    assert sum(p["size"] for p in pieces) == (tmp_path / "src/a.py").stat().st_size and len(pieces) == 5 and all(p["size"] <= 100 for p in pieces)


def test_document_counts(spark):
    blocks = documents.parse_documents(put(spark, [("a.md", "# T\n\none\n\n## S\n\ntwo\n\nthree\n"), ("b.txt", "")], "path string, content string"))
    assert {r.path: (r.sections, r.blocks) for r in documents.document_counts(blocks).collect()}["a.md"] == (2, 3)

