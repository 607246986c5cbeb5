"""The registered queries of the core operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.functions import tokens as K
from sievework.functions.tables import COUNTED_MODELS, PII_PATTERNS
from sievework.operators import chunking, context, corpus, detect, diff_output, distill, emit, graph, index, rank, state, transform
from sievework.plans import embed, ingest, repo_map
from sievework.sources import code, documents, scan

Query = Callable[[SparkSession, str], DataFrame]


#: Tables whose rows are large texts: worth spreading when they come in fewer partitions than there are cores.
_TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. A text table of few row groups is spread over all cores; a large one has enough partitions and isn't shuffled."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in _TEXTS and rows.rdd.getNumPartitions() < cores else rows


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def scan_language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.language_stats(table(spark, sf_dir, "documents"), "lang", "text")


def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.scan_totals(docs(spark, sf_dir).select(F.octet_length("text").cast("long").alias("size_bytes")))


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.models(spark).select("model", "context_window", "default_budget", "vendor", "exact")


def token_estimate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.token_counts(docs(spark, sf_dir))


def cheapest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.cheapest_model(docs(spark, sf_dir))


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select(K.estimates(F.col("text"), COUNTED_MODELS).alias("t"))
    return rows.agg(*[F.sum(f"t.{m}").alias(m) for m in COUNTED_MODELS])


def exceeds_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", K.estimate(F.col("text"), "claude").alias("tokens"), K.exceeds(F.col("text"), "claude", 100).alias("exceeds"))


def quick_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    size = F.octet_length("text")
    return rows.select(
        "item_id", *[K.quick_estimate(F.col("text"), m).alias(f"quick_{m}") for m in ("claude", "gemini")], K.scan_estimate(size, "cohere").alias("scan_cohere")
    )


def remove_empty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.remove_empty_lines(F.concat("text", F.lit("\n\n  \n"), "text"))
    return docs(spark, sf_dir).select("doc_id", F.md5(out.cast("binary")).alias("digest"))


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.remove_empty_lines(F.concat("text", F.lit("\n \nend")), numbered=True)
    return docs(spark, sf_dir).select("doc_id", F.md5(out.cast("binary")).alias("digest"))


def normalize_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.duplicates(docs(spark, sf_dir), "doc_id", X.normalize_lines(F.col("text")))


def paragraph_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.mark_repeats(distill.line_blocks(docs(spark, sf_dir))).select("doc_id", "block_ord", "kept")


def strip_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = distill.line_blocks(docs(spark, sf_dir))
    gone = distill.is_worthless(F.col("text"))
    return blocks.groupBy("doc_id").agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("dropped"))


def section_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distill.score_sections(distill.line_blocks(docs(spark, sf_dir)))
    return scored.select("doc_id", F.round("importance", 6).alias("importance"))


def arrange_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = distill.line_blocks(docs(spark, sf_dir))
    scored = blocks.select("doc_id", "block_ord", F.round(distill.paragraph_score(F.col("text")), 6).alias("importance"))
    return distill.arrange(scored, "doc_id", "block_ord").select("doc_id", "block_ord", "new_ord")


def compress_fillers(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = emit.emit_document(distill.compress(distill.line_blocks(docs(spark, sf_dir))))
    return done.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.md5(F.col("text").cast("binary")).alias("digest"))


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.summary(table(spark, sf_dir, "documents"))


def ingest_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest(docs(spark, sf_dir)).select("doc_id", "ord", "block_ord", "chunk", "tokens", F.md5(F.col("text").cast("binary")).alias("digest"))


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.secret_findings(docs(spark, sf_dir))


def secret_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.secret_summary(detect.secret_findings(docs(spark, sf_dir)))


_KINDS = list(PII_PATTERNS)


def pii_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.pii_matches(docs(spark, sf_dir), _KINDS)


def pii_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.pii_summary(detect.pii_matches(docs(spark, sf_dir), _KINDS))


def pii_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.pii_findings(docs(spark, sf_dir))


def pii_redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.redact_kind(F.col("text"), "email")
    return docs(spark, sf_dir).select("doc_id", F.md5(out.cast("binary")).alias("digest"))


def pii_redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.redact_pii_udf()("text")
    return docs(spark, sf_dir).select("doc_id", F.regexp_count(out, F.lit(r"\[REDACTED-")).alias("n_redacted"), F.md5(out.cast("binary")).alias("digest"))


def secret_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.redact_secrets_udf()("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(out.cast("binary")).alias("digest"))


def license_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.license_files(docs(spark, sf_dir))


def license_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.license_summary(detect.license_files(docs(spark, sf_dir)))


def license_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    commented = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("// SPDX-License-Identifier: LGPL-3.0\n# "), F.replace("text", F.lit("\n"), F.lit("\n# "))).alias("text"))
    return detect.license_headers(commented)


def html_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_replace("html", r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>|<footer[^>]*>.*?</footer>|<!--.*?-->", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"\s+", " "))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.octet_length(plain).alias("text_bytes"))


def _sized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = distill.line_blocks(docs(spark, sf_dir))
    return blocks.select("doc_id", "block_ord", K.estimate(F.col("text"), "claude").cast("long").alias("tokens"))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = corpus.pack_chunks(_sized_lines(spark, sf_dir), ["doc_id"], ["block_ord"], "tokens", 400, "block_ord")
    return corpus.chunk_summary(packed, ["doc_id"], "tokens")


def module_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", K.estimate(F.col("text"), "claude").cast("long").alias("tokens"))
    packed = corpus.pack_chunks(rows, ["source"], ["doc_id"], "tokens", 4000, "doc_id", split=True)
    return corpus.chunk_summary(packed, ["source"], "tokens")


def budget_enforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "source", "doc_id", (F.col("n_chars") % 7).alias("importance"), K.estimate(F.col("text"), "claude").cast("long").alias("tokens")
    )
    return corpus.enforce_budget(rows, ["source"], "importance", "doc_id", "tokens", 20_000)


def top_n_by_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars", "quality")
    return corpus.top_n(rows, F.col("quality") * 1_000_000 + F.col("n_chars"), "doc_id", 25).select("doc_id", "score", "rank")


def sample_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sample_rows(docs(spark, sf_dir).select("doc_id"), "doc_id", 50)


def keyword_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.char_length(w) >= 4)
    top = corpus.keyword_top(docs(spark, sf_dir), "doc_id", words)
    return top.select("doc_id", F.array_join("words", " ").alias("words"))


def module_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", F.lit("/p")).alias("src"))
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("nation"), "s_nationkey", F.lit("/s")).alias("dst"))
    edges = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(parts, "l_partkey").join(nation, "l_suppkey").select("src", "dst")
    return graph.module_graph(edges, lambda c: F.split_part(c, F.lit("/"), F.lit(1)))


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer, supplier and nation graph: an edge for each item that a customer had of a supplier, and one from each supplier to its nation."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    supplier, nation = lambda c: F.col(c) + 1_000_000_000, lambda c: F.col(c).cast("long") + 2_000_000_000
    bought = items.select(F.col("o_custkey").alias("src"), supplier("l_suppkey").alias("dst"))
    return bought.unionByName(table(spark, sf_dir, "supplier").select(supplier("s_suppkey").alias("src"), nation("s_nationkey").alias("dst")))


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(_supply(spark, sf_dir)).select("node", F.round("rank", 8).alias("rank"))


def map_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.map_pagerank(_sparse(spark, sf_dir)).select("node", F.round("rank", 8).alias("rank"))


def file_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_importance(_supply(spark, sf_dir)).select("node", F.round("rank", 8).alias("rank"))


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse graph over all parts: p to p*7 mod 211 and, for each fifth, to p*p mod 197."""
    p = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(p)
    return parts.select(p.alias("src"), ((p * 7) % 211).alias("dst")).union(parts.filter(p % 5 == 0).select(p, (p * p) % 197))


def scc_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(_sparse(spark, sf_dir))


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_sparse(spark, sf_dir)).select("src", "dst")


def transitive_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = spark.range(3, 6).withColumnRenamed("id", "node")
    return graph.reachable(_sparse(spark, sf_dir), starts, 3, backwards=True)


def callers_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_sparse(spark, sf_dir))


def call_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.call_chain(_sparse(spark, sf_dir), graph.nodes_of(_sparse(spark, sf_dir)))


def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _sparse(spark, sf_dir).filter("src > dst").unionByName(_sparse(spark, sf_dir).filter("src < dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.topological_levels(edges)


def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    symbols = parts.select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("file"), F.concat(F.lit("f"), F.col("p_size")).alias("name"))
    calls = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("caller_id"), F.lit("Brand#11").alias("file"), F.concat(F.lit("f"), F.col("s_nationkey")).alias("name"))
    imports = spark.createDataFrame([("Brand#11", "Brand#22"), ("Brand#11", "Brand#33")], "file string, imported string")
    return graph.resolve_calls(calls, symbols, imports)


def range_line_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    spans = p.select("p_brand", (F.col("p_partkey") % 500).alias("start"), "p_size", F.col("p_partkey").alias("symbol_id"))
    spans = spans.select(F.col("p_brand").alias("file"), "start", (F.col("start") + F.col("p_size")).alias("end"), "symbol_id")
    points = p.select(F.col("p_brand").alias("file"), (F.col("p_partkey") * 3 % 500).alias("line")).distinct()
    return graph.innermost_span(points, spans)


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    now = docs(spark, sf_dir).filter("doc_id % 10 != 3")
    changed = F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    before = docs(spark, sf_dir).filter("doc_id % 10 != 7").withColumn("text", changed)
    return state.manifest_of(now, "doc_id", "text"), state.manifest_of(before, "doc_id", "text")


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.manifest_diff(*_versions(spark, sf_dir)).select("location_key", "status")


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = state.manifest_diff(*_versions(spark, sf_dir))
    return state.upserts(diff).unionByName(state.deletes(diff))


def manifest_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.manifest_checksum(_versions(spark, sf_dir)[0])


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", X.content_hash(F.col("text")).alias("full_hash"))
    key = X.location_key(F.col("source"), F.col("lang"), F.col("doc_id"))
    return rows.select("doc_id", X.chunk_id(key, F.col("full_hash")).alias("chunk_id"), key.alias("location_key"))


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select((F.col("doc_id") % 50).alias("chunk_id"), X.content_hash(F.col("text")).alias("full_hash"))
    return state.collisions(rows)


def cache_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("mtime"), F.col("n_chars").alias("size"), F.md5(F.col("text").cast("binary")).alias("hash"))
    cache = rows.filter("path % 4 != 1").withColumn("size", F.when(F.col("path") % 6 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return state.needs_rescan(rows, cache).select("path", "size")


def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    return state.deleted_files(rows, rows.filter("path % 3 != 0"))


def upsert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.batches(docs(spark, sf_dir).select("doc_id"), ["doc_id"], 64)


def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("log"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("hash")
    )
    from pyspark.sql.window import Window

    before = F.lag("hash").over(Window.partitionBy("log").orderBy("seq"))
    tampered = F.when(F.col("seq") % 97 == 0, F.lit("x")).otherwise(before)
    return state.verify_chain(rows.withColumn("prev_hash", tampered), ["log"]).select("log", "seq")


def unused_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return rank.unused(table(spark, sf_dir, "part").select("p_partkey"), used, "p_partkey")


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    a = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    pairs = rows.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")).join(F.broadcast(a), F.col("a") != F.col("b"))  # stated query set
    return pairs.select("a", "b", F.round(X.cosine(F.col("x"), F.col("y")), 4).alias("similarity")).filter("similarity >= 0.3")


def watch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return state.sessions(events, "user_id", "ts", "30 minutes").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def commit_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.recent_counts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", 90)




def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "^m[.]", "tests/")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(path, F.lit("/src/index.ts")).alias("path"))


def file_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _page_paths(spark, sf_dir).unionByName(_page_paths(spark, sf_dir).withColumn("path", F.regexp_replace("path", "src/index.ts$", "lib/user_service.py")))
    score = rank.file_importance(F.col("path"), (F.col("page_id") % 10).cast("double"))
    return rows.select("page_id", "path", F.round(score, 6).alias("importance"), rank.importance_bucket(F.round(score, 6)).alias("bucket"))


def filter_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.filter_paths(_page_paths(spark, sf_dir), ["*example.com*", "example.org/en"], ["tests", "www.*", "blog.ththti"])


def normalize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.concat(F.lit("./a/../"), F.col("path"), F.lit("//x/./y/../z"))
    return _page_paths(spark, sf_dir).select("page_id", X.normalize_path(messy).alias("path"), corpus.language_of(F.col("path")).alias("language"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("parseHTTP"), F.initcap("p_name"), F.lit("_v2"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.split_identifier(F.replace(name, F.lit(" "), F.lit(""))), " ").alias("words"))


def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("=<a b='c\\d'>|&\""), "text")
    return table(spark, sf_dir, "benchmark").select(
        "item_id", X.escape_xml(t).alias("xml"), X.escape_yaml(t).alias("yaml"), X.escape_cell(t).alias("cell"), X.sanitize_cell(t).alias("guarded"),
        X.mask(F.col("text")).alias("masked"), X.ellipsis(t, 40).alias("short"), X.first_sentence(F.col("text")).alias("sentence"),
    )


def data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.lit(" data:image/png;base64,"), F.base64(F.col("text").cast("binary")), F.lit(" end"))
    return table(spark, sf_dir, "benchmark").select("item_id", X.truncate_data_uris(F.regexp_replace(t, "[\r\n]", "")).alias("text"))


def halstead_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").alias("n1"), (F.col("p_partkey") % 13).alias("n2"), (F.col("p_size") * 3).alias("big1"), (F.col("p_partkey") % 13 * 5).alias("big2")
    )
    made = rank.halstead(F.col("n1"), F.col("n2"), F.col("big1"), F.col("big2"))
    names = ("volume", "difficulty", "effort", "bugs")
    index = rank.maintainability(made["volume"], F.col("n2"), F.col("n1"))
    return rows.select("p_partkey", *[F.round(made[n], 4).alias(n) for n in names], F.round(index, 4).alias("maintainability"))


def complexity_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").alias("cyclomatic"), (p % 37).alias("cognitive"), (p % 8).alias("nesting"), (p % 11).alias("parameters"), (p % 101).alias("maintainability")
    )
    return rank.complexity_gates(rows, "p_partkey")


def _versions_of_symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, k = F.col("p_partkey"), F.col("p_partkey") % 11
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("f"), p).alias("name"), k.alias("k"), F.concat("p_brand", F.lit(".py")).alias("file"), F.lit("def f(a: int, b) -> str").alias("signature"),
        F.lit("public").alias("visibility"), F.lit(None).cast("string").alias("extends"),
    )
    signature = (
        F.when(F.col("k") == 3, "def f(a: int, b) -> int").when(F.col("k") == 4, "def f(a: int, b, c) -> str").when(F.col("k") == 5, "def f(a: int) -> str")
        .when(F.col("k") == 6, "async def f(a: str, x) -> str").when(F.col("k") == 7, "def f<T, U>(a: int, b) -> str").otherwise(F.col("signature"))
    )
    new = rows.filter("k != 2").select(
        "name", F.when(F.col("k") == 8, "moved.py").otherwise(F.col("file")).alias("file"), signature.alias("signature"),
        F.when(F.col("k") == 9, "private").otherwise(F.col("visibility")).alias("visibility"), F.when(F.col("k") == 10, "Base").alias("extends"), "k",
    )
    return rows.filter("k != 1"), new.drop("k")


def breaking_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.breaking_changes(*_versions_of_symbols(spark, sf_dir))


def breaking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.breaking_summary(rank.breaking_changes(*_versions_of_symbols(spark, sf_dir)))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each part: it imports the file of part 7p mod 211 and has a class with a method that calls the file's own function."""
    p = F.col("p_partkey")
    path = lambda q: F.concat(F.lit("src/m"), q % 25, F.lit("/f"), q, F.lit(".py"))
    q = p * 7 % 211
    content = F.concat(
        F.lit("import m"), q % 25, F.lit(".f"), q, F.lit("\nimport os\n\nclass C"), p, F.lit("(B"), p % 5, F.lit('):\n    """Makes '), p,
        F.lit('. More."""\n    def run(self, a: int, b=2) -> str:\n        if a and b:\n            return helper'), p,
        F.lit('(a)  # call\n        return ""\n\ndef helper'), p, F.lit("(v):\n    return v\n"),
    )
    return table(spark, sf_dir, "part").select(path(p).alias("path"), F.lit("python").alias("language"), content.alias("content"))


def parsed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code.parse_symbols(_code(spark, sf_dir))
    return rows.select(
        "file", "name", "kind", "signature", "docstring", "start_line", "end_line", "parent", "visibility", F.array_join("calls", ",").alias("calls"), "extends"
    )


def import_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.resolve_imports(code.imports(_code(spark, sf_dir)), _code(spark, sf_dir))


def comment_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform.remove_comments_udf()("content", "language")
    return _code(spark, sf_dir).select("path", F.md5(out.cast("binary")).alias("digest"))


def signature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark, sf_dir).select("path", transform.signatures_udf()("content", "language").alias("text"))


def key_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.key_symbols(_code(spark, sf_dir), code.parse_symbols(_code(spark, sf_dir)))


def key_symbols_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.key_symbols(_code(spark, sf_dir), code.parse_symbols(_code(spark, sf_dir)), around=2)


def type_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.type_signatures(code.parse_symbols(_code(spark, sf_dir)))


def python_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.complexity(_code(spark, sf_dir)).select("file", "name", "start_line", "cyclomatic", "nesting", "parameters", "returns")


def branch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark, sf_dir).select("path", code.branch_count(F.col("content"), F.col("language")).alias("complexity"))


def text_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = code.parse_symbols(_code(spark, sf_dir)).filter("kind = 'function'").select(F.col("name").alias("symbol_id"), "file", "name")
    return graph.text_references(_code(spark, sf_dir), symbols)


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = code.parse_symbols(_code(spark, sf_dir)).filter("kind = 'function'").select(F.col("name").alias("symbol_id"), "file", "name")
    return index.call_sites(_code(spark, sf_dir), symbols, "helper3")


def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = index.build_index(_code(spark, sf_dir))["files"]
    return built.select("path", "language", "content_hash", "lines", "tokens", F.round("importance", 8).alias("importance"))


def index_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_index(_code(spark, sf_dir))["symbols"].select("symbol_id", "file", "name", "kind", "parent_id")


def index_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_index(_code(spark, sf_dir))["edges"]


def _named_symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = F.col("p_partkey")
    symbols = table(spark, sf_dir, "part").select(p.alias("symbol_id"), F.concat("p_brand", F.lit(".py")).alias("file"), F.col("p_name").alias("name"), F.col("p_size").alias("start_line"))
    return symbols, _sparse(spark, sf_dir).withColumn("edge_type", F.when(F.col("src") % 2 == 0, "call").otherwise("reference"))


def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.find_symbol(_named_symbols(spark, sf_dir)[0], "red widget").select("file", "start_line", "name")


def callers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.callers_of(*_named_symbols(spark, sf_dir), "red widget")


def callees_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.callees_of(*_named_symbols(spark, sf_dir), "red widget")


def references_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.references_of(*_named_symbols(spark, sf_dir), "red widget")


def cycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of five parts, each with a chord that makes a second, shorter cycle."""
    p = F.col("p_partkey")
    ring = table(spark, sf_dir, "part").select(p.alias("src"), (F.floor(p / 5) * 5 + (p + 1) % 5).alias("dst"))
    chord = table(spark, sf_dir, "part").filter("p_partkey % 5 = 2").select(p.alias("src"), (p - 2).alias("dst"))
    return index.cycle_paths(ring.unionByName(chord)).select(F.array_join("cycle", ">").alias("cycle"))


def dependency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.dependency_stats(_code(spark, sf_dir), code.resolve_imports(code.imports(_code(spark, sf_dir)), _code(spark, sf_dir)))


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("size"), F.col("o_custkey").alias("tokens"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    return index.cache_stats(rows, F.lit("2030-01-01 00:00:00").cast("timestamp"))


def multi_repo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), F.col("p_name").alias("name"))
    links = table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), F.col("p_type").alias("target_repo")).filter("repo < 'Brand#2'")
    return index.multi_repo_stats(symbols, links)


def lazy_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = _code(spark, sf_dir).select("path").filter("path LIKE 'src/m1/%'")
    return index.lazy_context(_code(spark, sf_dir), changed, 2)


def context_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = {"edges": index.build_index(_code(spark, sf_dir))["edges"]}
    return index.context_impact(built, spark.createDataFrame([("src/m3/f3.py",), ("src/m7/f7.py",)], "path string"), 2)


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 10
    role = F.when(k == 0, "changed").when(k < 7, "dependent").otherwise("test")
    tokens = K.estimate(F.col("text"), "claude").cast("long")
    rows = table(spark, sf_dir, "documents").select(F.format_string("d%08d", "doc_id").alias("path"), role.alias("role"), (F.col("n_chars") % 97).cast("double").alias("relevance"), tokens.alias("tokens"))
    return index.context_budget(rows, 120_000)


def diff_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("item_id") % 5
    reason = F.when(k == 0, "changed symbol").when(k == 1, "dependent symbol").when(k == 2, "diff hunk").when(k == 3, "file removed").otherwise("other")
    rows = table(spark, sf_dir, "benchmark").select(
        F.format_string("f%06d", F.col("item_id") % 13).alias("path"), F.when(F.col("item_id") % 3 == 0, "test").otherwise("dependent").alias("role"), (F.col("item_id") % 4 / 4.0).alias("relevance"),
        F.col("item_id").cast("int").alias("ord"), reason.alias("reason"), K.estimate(F.col("text"), "claude").cast("long").alias("tokens"),
    )
    return index.diff_budget(rows, 100, 1200)


def _shaped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path of one of sixteen shapes for each part."""
    p, k = F.col("p_partkey"), F.col("p_partkey") % 16
    shapes = [
        "src/a{}/main.py", "node_modules/x{}/a.js", "a/b{}.min.js", "src/tests/t{}.py", "docs/d{}.md", "img/i{}.png", "x{}/__tests__/a.test.ts", "README{}.md",
        "lib/core/c{}/mod.rs", "x/api/routes/r{}.go", "x{}/package.json", "a/utils/u{}.rb", "vendor/v{}/lib/l.c", "cmd/x{}/y.go", "app/examples/e{}.java", "CHANGELOG{}",
    ]
    path = F.lit("")
    for i, shape in enumerate(shapes):
        path = F.when(k == i, F.replace(F.lit(shape), F.lit("{}"), p.cast("string"))).otherwise(path)
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))


def default_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _shaped_paths(spark, sf_dir).select(
        "p_partkey", corpus.is_ignored(path).alias("ignored"), corpus.is_ignored(path, tests=False).alias("without_tests"), corpus.is_ignored(path, docs=False).alias("without_docs")
    )


def gitignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("", 0, "*.js"), ("", 1, "/docs/"), ("", 2, "tests"), ("src", 0, "!tests/"), ("", 3, "x*/package.json"), ("lib", 0, "# no"), ("lib", 1, "**/mod.rs"), ("vendor", 0, "v1?/")]
    return corpus.gitignored(_shaped_paths(spark, sf_dir), spark.createDataFrame(rules, "folder string, ord int, pattern string"))


def path_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _shaped_paths(spark, sf_dir).select("p_partkey", rank.fast_rank(path).alias("fast"), rank.chunk_priority(path).alias("priority"))


def test_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _shaped_paths(spark, sf_dir).select(
        "p_partkey", context.is_test_file(path).alias("wide"), context.is_named_as_test(path).alias("named"), context.is_chunked_test(path).alias("chunked"), context.is_streamed_test(path).alias("streamed")
    )


def module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, language = F.col("path"), corpus.language_of(F.col("path"))
    return _shaped_paths(spark, sf_dir).select(
        "p_partkey", X.module_path(path, F.coalesce(language, F.lit(""))).alias("module"), X.qualified_name(path, F.lit("P"), F.lit("f"), F.lit("r")).alias("qualified"), X.dotted_module(path).alias("dotted"),
        X.repository_module(path).alias("repository"),
    )


def truncated_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"), (F.col("n_chars") % 7).alias("importance"), K.estimate(F.col("text"), "claude").cast("long").alias("tokens"), F.col("text").alias("content")
    )
    done = corpus.truncated_to_budget(rows, 30_000)
    return done.select("path", "action", "used", F.md5(F.col("content").cast("binary")).alias("digest"))


def truncated_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = F.concat(F.lit("<file>"), F.replace("text", F.lit(". "), F.lit(".</file>\n<file>")), F.lit("</file>"))
    return table(spark, sf_dir, "benchmark").select("item_id", transform.truncate_output_udf(30)(framed).alias("text"))


def settings_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"model": "claude", "limit": 1000}
    plain = state.manifest_checksum(_versions(spark, sf_dir)[0])
    with_settings = state.manifest_checksum(_versions(spark, sf_dir)[0], settings)
    return plain.select("entries", F.lit(state.settings_hash(settings)).alias("settings")).join(with_settings, "entries")


def audit_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of events of each customer that are whole, and of those the length."""
    events = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("log"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, "scan_started").when(F.col("o_orderkey") % 3 == 1, "no such event").otherwise("data_exported").alias("event"),
        F.col("o_orderpriority").alias("detail"),
    )
    chained = state.chained_audit(events, "log")
    broken = state.verify_chain(chained, ["log"]).select("log").distinct()
    return chained.join(broken, "log", "left_anti").groupBy("log").agg(F.count("*").alias("events"), F.count_distinct("hash").alias("hashes"))


def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = docs(spark, sf_dir).select(F.concat("doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("# Title\n\none two\n\n## Part\n\nthree "), "doc_id", F.lit("\n")).alias("content"))
    return documents.document_counts(documents.parse_documents(files))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("# Head "), "n_nationkey", F.lit("\n\nFirst "), "n_name", F.lit("\nline\n\n- a\n- b\n\n```sql\nselect 1\n```\n\n## Sub\n\n> said\n"))
    files = table(spark, sf_dir, "nation").select(F.concat("n_nationkey", F.lit(".md")).alias("path"), body.alias("content"))
    return documents.parse_documents(files).select("path", "block_type", "text", "title")


def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = embed.chunks(_code(spark, sf_dir))
    return made.select("file", "name", "kind", "parent", "part", "tokens", F.md5(F.col("content").cast("binary")).alias("digest"))


def map_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    symbols = table(spark, sf_dir, "part").select(p.alias("symbol_id"), F.concat("p_brand", F.lit("/x.py")).alias("file"), F.col("p_name").alias("name"), F.lit("function").alias("kind"))
    sizes = symbols.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("symbols"))
    made = repo_map.repo_map(symbols, _sparse(spark, sf_dir), sizes)
    return made["module_edges"].select("src_module", "dst_module", "weight")


def sample_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sample_share(docs(spark, sf_dir).select("doc_id"), "doc_id", 20)[0]


def within_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, rejected = corpus.within_limits(docs(spark, sf_dir), 2000, 300, "text")
    return accepted.select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("doc_id", "reason"))


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.file_chunks(docs(spark, sf_dir).select(F.col("doc_id").alias("ord"))).select("ord", F.col("chunk").cast("long").alias("chunk"))


def symbol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = code.parse_symbols(_code(spark, sf_dir)).withColumn("importance", F.when(F.col("kind") == "class", 1.0).otherwise(0.5))
    snippets = chunking.symbol_snippets(symbols, _code(spark, sf_dir).withColumn("importance", F.lit(0.5)))
    return chunking.symbol_chunks(snippets, 400)


def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    none = F.array().cast("array<string>")
    symbols = table(spark, sf_dir, "part").select(
        F.concat(F.lit("f"), p).alias("name"), F.col("p_brand").alias("file"), F.array(F.concat(F.lit("f"), p * 7 % 211)).alias("calls"), none.alias("implements"),
        F.when(p % 3 == 0, F.concat(F.lit("f"), p % 5)).alias("extends"),
    )
    placed = symbols.select(F.col("file").alias("path")).distinct().withColumn("chunk", F.substring("path", 7, 2).cast("int") % 6)
    return chunking.cross_references(symbols, placed)


def changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    symbols = table(spark, sf_dir, "part").select(p.alias("symbol_id"), F.col("p_brand").alias("file"), (p % 200).alias("start_line"), (p % 200 + F.col("p_size")).alias("end_line"))
    ranges = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), s % 25 + 1).alias("file"), (s * 3 % 200).alias("start"), (s * 3 % 200 + 5).alias("end"))
    return context.changed_symbols(ranges, symbols)


def updated_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    files = parts.select(F.col("p_type").alias("file")).distinct().withColumn("importance", F.lit(0.5))
    done = rank.updated_importance(files, parts.select(F.col("p_type").alias("file"), (F.col("p_size") / 50.0).alias("score")))
    return done.select("file", F.round("importance", 9).alias("importance"))


def proto_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    body = F.concat(F.lit('syntax = "proto3";\npackage api.n'), k, F.lit(";\n// message Hidden\nservice S"), k, F.lit(" {\n  rpc Get"), k, F.lit("(A) returns (B);\n}\nmessage A {}\nenum E"), k, F.lit(" {}\n"))
    return scan.contracts(table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".proto")).alias("path"), body.alias("content")))


def doc_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit("Makes it.\n@param x the "), "n_name", F.lit("\n * @returns {int} a number\n:raises ValueError: if "), "n_nationkey", F.lit("\n"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(code.doc_tags(doc)).alias("t"))
    return rows.select("n_nationkey", "t.tag", "t.name", "t.text")


def base64_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.concat(F.repeat(F.lit("aB3"), 50), F.lit("+"), F.repeat(F.lit("xyz"), 40))
    return table(spark, sf_dir, "benchmark").select("item_id", X.truncate_base64(F.concat("text", F.lit(" "), run, F.lit(" end"))).alias("text"))


def folder_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.token_tree(_shaped_paths(spark, sf_dir).select("path", (F.col("p_partkey") % 10).alias("tokens")))


def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("score"))
    return rank.ranks(rows, ["p_brand"], "score", "p_partkey").withColumn("around", F.round("around", 6)).withColumn("percent_rank", F.round("percent_rank", 9))


def global_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank_all(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey").select("p_partkey", F.col("rank").cast("long").alias("rank"))


def exported_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.exported_symbols(code.parse_symbols(_code(spark, sf_dir))).select("file", "name", "kind")


def limited_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.limited_call_graph(_sparse(spark, sf_dir), 150, 120)


def chunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("chunk"), F.col("n_name").alias("focus"))
    placed = chunking.with_neighbours(rows, ["n_regionkey"])
    return placed.select("n_regionkey", "chunk", emit.chunk_header(F.col("chunk"), F.col("total"), F.col("focus")).alias("header"))


def type_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.descendants(_types(spark, sf_dir)).filter("depth <= 2")


def retrieval_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(n) for n in ("get_user", "parse_file", "test_login", "Handler", "set_name", "__init__")]), (p % 6 + 1).cast("int"))
    kind = F.when(p % 2 == 0, "function").otherwise("class")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(context.tags_of(name, F.lit("async def"), kind), ",").alias("tags"))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small change context for each nation."""
    key = F.col("n_nationkey")
    snippets = F.array(F.struct(F.lit(1).alias("start_line"), key.alias("end_line"), F.lit('changed "symbol"').alias("reason"), F.concat("n_name", F.lit("\nx")).alias("content")))
    none = F.slice(snippets, 1, 0)
    parts = {
        "level": F.when(key % 2 == 0, "low").otherwise("high"), "description": F.concat(F.lit("About "), "n_name"), "direct_files": key, "transitive_files": key * 2, "affected_symbols": F.lit(3),
        "affected_tests": F.lit(1), "total_tokens": key * 10,
        "changed_files": F.array(F.struct(
            F.concat("n_name", F.lit(".py")).alias("path"), F.lit("python").alias("language"), key.alias("tokens"), F.when(key % 3 == 0, "-a\n+b").alias("diff_content"),
            F.when(key % 5 == 0, F.array(F.struct(F.lit("ab12").alias("hash"), F.lit("A").alias("author"), F.lit("2024").alias("date"), F.lit("say x").alias("message")))).otherwise(
                F.array().cast("array<struct<hash:string,author:string,date:string,message:string>>")).alias("history"),
            F.when(key % 4 == 0, none).otherwise(snippets).alias("snippets"),
        )),
        "changed_symbols": F.array(F.struct(F.col("n_name").alias("name"), F.lit("function").alias("kind"), F.lit("a.py").alias("file"), key.alias("line"))),
        "dependent_symbols": F.array(F.struct(F.lit("g").alias("name"), F.lit("class").alias("kind"), F.lit("b.py").alias("file"), key.alias("line"), F.lit("calls it").alias("reason"), F.lit(0.7).cast("double").alias("relevance"))),
        "dependent_files": F.array(F.struct(F.lit("b.py").alias("path"), F.lit("imports it").alias("reason"), F.lit(0.5).cast("double").alias("relevance"), none.alias("snippets"))),
        "related_tests": F.array(F.struct(F.lit("t.py").alias("path"), snippets.alias("snippets"))),
        "call_chains": F.array(F.array(F.lit("f"), F.col("n_name"))),
    }
    return table(spark, sf_dir, "nation").select(key, *[c.alias(n) for n, c in parts.items()])


def _formatter(form: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return diff_output.format_context(_contexts(spark, sf_dir), form).select("n_nationkey", "text")

    return query


def symbol_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "class").when(F.col("p_partkey") % 3 == 1, "function").otherwise("import")
    symbols = parts.select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_partkey"), kind.alias("kind"), F.lit(1).alias("start_line"), F.col("p_size").alias("end_line"))
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).join(parts, "p_partkey").select(F.col("p_name").alias("name"))
    imports = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey")).join(parts, "p_partkey").select(F.col("p_name").alias("name"))
    files = parts.select(F.col("p_brand").alias("file")).distinct().withColumn("importance", F.lit(0.5))
    scored = rank.symbol_scores(rank.reference_counts(symbols, calls, imports), files)
    return scored.select("p_partkey", F.col("references").alias("refs"), F.round("score", 6).alias("score"))


def impact_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = graph.degrees(_sparse(spark, sf_dir))
    return degree.select("node", rank.impact_level(F.col("callers"), F.col("callers") * 3 + F.col("callees")).alias("level"))


def common_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.explode(F.split(F.upper("p_name"), " ")).alias("name")
    return rank.common_symbols(table(spark, sf_dir, "part").select(word), table(spark, sf_dir, "part").select(F.col("p_type").alias("name")))


def _as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.concat(F.lit("d/<"), "item_id", F.lit(">|.md")).alias("path"), "text")
    return rows.select("ord", "path", F.when(F.col("ord") % 3 != 0, "markdown").alias("language"), F.concat(F.lit("a ``` ]]> \"q\" ,\n"), "text").alias("content"))


def _emitter(form: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return emit.emit(_as_files(spark, sf_dir), form)

    return query


def emit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.emit_document(distill.line_blocks(docs(spark, sf_dir))).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("/"), "p_size", F.lit(".py")).alias("file"),
        F.when(F.col("p_partkey") % 4 == 0, F.floor(F.col("p_partkey") / 2)).alias("parent_id"),
    )
    vertices, edges = emit.graph_export(symbols, _sparse(spark, sf_dir))
    none = F.lit(None).cast("string")
    return vertices.select("id", "label", "name", none.alias("src"), none.alias("dst")).unionByName(edges.select("id", "label", none.alias("name"), "src", "dst"))


def pack_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _page_paths(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content")), "page_id")
    files = files.select(F.concat("path", F.lit("#"), "page_id").alias("path"), "content")
    return ingest.pack(files, 100_000, exclude=["tests"]).select("path", F.round("importance", 6).alias("importance"), "tokens", "action", "used")


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.concat("page_id", F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return documents.parse_documents(files).select("path", "block_type", "block_ord", F.md5(F.col("text").cast("binary")).alias("digest"))


def plain_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = docs(spark, sf_dir).select(F.concat("doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return documents.parse_documents(files).select("path", "block_type", "section_ord", "block_ord", F.md5(F.col("text").cast("binary")).alias("digest"))


def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(";", "n_nationkey", "n_name", F.concat(F.lit("="), F.col("n_regionkey")))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    files = rows.select(F.concat("n_regionkey", F.lit(".csv")).alias("path"), F.concat(F.lit("k;name;r\n"), "body").alias("content"))
    return documents.parse_documents(files).select("path", "block_type", "text")


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("item_id") + 1
    body = F.concat(F.lit("--- a\n+++ b\n@@ -"), at, F.lit(",2 +"), at, F.lit(",3 @@ f\n same\n-old\n+new\n+"), F.replace("text", F.lit("\n"), F.lit(" ")))
    return scan.diff_lines(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), body.alias("diff")))


def classify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 9
    change = F.when(k == 0, "deleted").when(k == 1, "renamed").when(k == 2, "added").otherwise("modified")
    diff = F.when(k == 3, "+fn a()").when(k == 4, "-  struct A").when(k == 5, "+use b;\n c").when(k == 6, "+/// doc\n-# x").when(k == 7, "+x = 1")
    kind = F.when(F.col("p_size") % 2 == 0, "class").otherwise("function")
    found = table(spark, sf_dir, "part").select("p_partkey", context.classify_change(change, diff, kind).alias("class"))
    return found.withColumn("weight", context.change_weight(F.col("class")))


def expand_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = graph.nodes_of(_sparse(spark, sf_dir)).select(F.col("node").alias("symbol_id"), F.concat(F.lit("f"), F.col("node") % 7, F.when(F.col("node") % 5 == 0, "_test").otherwise("")).alias("file"))
    changed = spark.range(10, 14).select(F.col("id").alias("symbol_id"))
    return context.expand_context(changed, _sparse(spark, sf_dir), symbols, 2)


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    parent = F.when(p > 2, F.concat(F.lit("T"), F.floor(p / 3)))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("T"), p).alias("name"), parent.alias("parent"))


def type_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.ancestors(_types(spark, sf_dir))


def type_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.hierarchy_depth(_types(spark, sf_dir))


def type_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = _types(spark, sf_dir)
    return rank.type_roots(types).withColumn("end", F.lit("root")).unionByName(rank.type_leaves(types).withColumn("end", F.lit("leaf")))


def link_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(
        p.alias("id"), F.col("p_brand").alias("file"), F.concat(F.lit("n"), p % 11).alias("name"), F.when(p % 2 == 1, F.concat(F.lit("n"), p % 7)).alias("parent"),
        (p % 200).cast("int").alias("start_line"), (p % 200 + F.col("p_size")).cast("int").alias("end_line"),
    )
    return context.link_parents(parts)


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part")
    symbols = parts.select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("file"), F.concat(F.lit("f"), F.col("p_partkey") % 601).alias("name"))
    calls = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("caller_id"), F.concat(F.lit("Brand#1"), F.col("s_suppkey") % 5 + 1).alias("file"), F.concat(F.lit("f"), F.col("s_suppkey") * 5 % 601).alias("name"))
    imports = calls.select("file", F.lit("Brand#22").alias("imported")).distinct()
    return calls, symbols, imports


def resolve_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.resolve_unique(*_named(spark, sf_dir))


def called_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = context.resolve_unique(*_named(spark, sf_dir))
    return context.called_by(resolved).select("symbol_id", F.array_join(F.transform("callers", lambda c: c.cast("string")), ",").alias("callers"), F.col("n").cast("long").alias("n"))


def merge_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    chunks = table(spark, sf_dir, "part").select(
        p.alias("id"), F.lit("r").alias("repo"), F.col("p_brand").alias("file"), F.col("p_size").alias("start_line"), F.lit(99).alias("end_line"), F.lit("h").alias("full_hash"),
        F.col("p_name").alias("name"), F.array("p_type").alias("tags"), (p % 50).alias("tokens"),
    )
    merged = context.merge_aliases(chunks)
    return merged.select("file", "start_line", "id", "name", F.array_join("tags", "|").alias("tags"), "tokens", F.size("aliases").cast("long").alias("aliases"))


def cross_repo_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), F.substring("p_brand", 7, 2).cast("int").alias("repo_ord"), "p_name", "p_partkey")
    known = parts.select("repo", "repo_ord", F.concat("p_name", F.lit(" "), F.col("p_partkey") % 9).alias("name"))
    uses = parts.select("repo", "repo_ord", F.concat("p_name", F.lit(" "), F.col("p_partkey") * 5 % 9).alias("name"), F.lit("call").alias("kind"))
    return context.cross_repo_links(uses, known)


def hierarchy_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "nation").select(
        F.lit("f").alias("file"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("parent"), F.col("n_nationkey").alias("start_line"), F.lit("method").alias("kind"),
        F.lit(None).cast("string").alias("signature"), F.col("n_name").alias("name"),
    )
    return context.hierarchy_summaries(members)


def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    symbols = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("file"), F.concat(F.when(p % 10 == 0, "test_").otherwise("s"), p).alias("name"),
        F.when(p % 3 == 0, "function").when(p % 3 == 1, "class").otherwise("constant").alias("kind"), F.when(p % 2 == 0, "private").otherwise("public").alias("visibility"),
        F.when(p % 7 == 0, "rust").otherwise("python").alias("language"),
    )
    used = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey") * 7).alias("name"))
    return rank.dead_code(symbols, used).select("file", "name", "kind", F.round("confidence", 6).alias("confidence"))


def tests_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    sources = parts.select(F.concat(F.lit("src/m"), p, F.lit(".py")).alias("path"))
    shape = F.when(p % 3 == 0, F.concat(F.lit("tests/m"), p, F.lit("x.py"))).when(p % 3 == 1, F.concat(F.lit("a/test_m"), p, F.lit(".py"))).otherwise(F.concat(F.lit("a/xm"), p, F.lit("_test.go")))
    return context.tests_by_name(sources, parts.select(shape.alias("path")))


def unreachable_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    body = F.concat(F.lit("def f():\n  "), F.when(p % 3 == 0, "return 1").otherwise("x = 1"), F.lit("\n\n  # c\n  "), F.when(p % 2 == 0, "else:").otherwise("y()"), F.lit("\n  z()\n"))
    return code.unreachable(table(spark, sf_dir, "part").select(p.cast("string").alias("path"), body.alias("content")))


def code_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_size")
    body = F.concat(F.repeat(F.lit("{\n"), p), F.lit("# no\n\n x\n"), F.repeat(F.lit("}\n"), p))
    return table(spark, sf_dir, "part").select("p_partkey", code.lines_of_code(body).alias("loc"), code.brace_depth(body).alias("depth"))


def remote_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    url = F.when(s % 3 == 0, F.concat(F.lit("https://github.com/o"), s, F.lit("/r.git"))).when(s % 3 == 1, F.concat(F.lit("git@gitlab.com:g/p"), s)).otherwise(F.concat(F.lit("path/"), s))
    return table(spark, sf_dir, "supplier").select("s_suppkey", scan.remote_parts(url).alias("r")).select("s_suppkey", "r.provider", "r.owner", "r.name")


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("path"), K.estimate(F.col("text"), "claude").cast("long").alias("tokens"))
    return chunking.fixed_chunks(rows, 8000).select("path", "tokens", "chunk")


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), K.estimate(F.col("text"), "claude").cast("long").alias("tokens"))
    return chunking.semantic_chunks(rows, 8000)


def dependency_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _types(spark, sf_dir).select(F.col("name").alias("path"), F.char_length("name").cast("long").alias("tokens"))
    return chunking.dependency_chunks(rows, _types(spark, sf_dir).filter("parent IS NOT NULL").select(F.col("name").alias("path"), F.col("parent").alias("resolved")), 50)


def chunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("chunk"), F.col("n_name").alias("focus"))
    return chunking.with_neighbours(rows, ["n_regionkey"])


def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(transform.truncate_udf(100)("text").cast("binary")).alias("digest"))


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_long(docs(spark, sf_dir), "doc_id", "text", 200).select("doc_id", "part", F.md5(F.col("text").cast("binary")).alias("digest"))


def semantic_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return docs(spark, sf_dir).select("doc_id", F.md5(transform.semantic_compress_udf()(spaced).cast("binary")).alias("digest"))


def character_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", transform.character_vector_udf()("text").alias("v"))
    return rows.select("item_id", F.posexplode("v").alias("bucket", "x")).filter("x != 0").select("item_id", "bucket", F.round(F.col("x").cast("double"), 4).alias("x"))


def rollup_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))
    return rows


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        scan_language_stats, scan_totals, model_table, token_estimate_all, cheapest_model, token_totals, exceeds_budget, quick_estimates,
        remove_empty_lines, numbered_lines, normalize_hash_dups, paragraph_first_seen, strip_boilerplate, section_score, arrange_thirds,
        compress_fillers, ingest_summary, ingest_full, secret_findings, secret_summary, pii_findings, pii_summary, pii_all_kinds,
        pii_redact_email, pii_redact_all, secret_redact, license_files, license_risk, license_headers, html_title_text, doc_chunks,
        module_chunks, budget_enforce, top_n_by_importance, sample_documents, keyword_top, module_graph, pagerank, map_pagerank, file_importance,
        scc_cycles, closure, transitive_callers, callers_callees, call_chain, topological_levels, resolve_calls, range_line_symbol,
        manifest_diff, manifest_rows, manifest_checksum, chunk_ids, collisions, cache_staleness, deleted_files, upsert_batches,
        audit_chain, unused_parts, cosine_pairs, watch_sessions, commit_frequency, file_rank, filter_paths, normalize_paths, identifiers,
        escapes, data_uris, halstead_measures, complexity_gates, breaking_changes, symbol_scores, impact_levels, common_symbols,
        emit_documents, graph_export, pack_pages, html_blocks, plain_sections, csv_tables, diff_lines, classify_changes, expand_context,
        type_ancestors, type_depths, type_ends, link_parents, resolve_unique, called_by, merge_aliases, cross_repo_links,
        hierarchy_summaries, dead_code, tests_by_name, unreachable_code, code_measures, remote_urls, fixed_chunks, semantic_chunks,
        breaking_summary, parsed_symbols, import_links, comment_removal, signature_lines, key_symbols, key_symbols_in_context, type_signatures,
        python_complexity, branch_counts, text_references, call_sites, index_files, index_symbols, index_edges, find_symbol, callers_of,
        callees_of, references_of, cycle_paths, dependency_stats, cache_stats, multi_repo_stats, lazy_context, context_impact, context_budget,
        diff_budget, default_ignores, gitignored, path_ranks, test_predicates, module_paths, truncated_contents, truncated_output,
        settings_checksum, audit_chains, document_counts, markdown_blocks, embed_chunks, map_symbols, sample_shares,
        within_limits, file_chunks, symbol_chunks, cross_references, changed_symbols, updated_importance, proto_contracts, doc_tags, base64_runs,
        folder_tokens, window_ranks, global_ranks, exported_symbols, limited_call_graph, chunk_headers, type_relatives, retrieval_tags,
        dependency_chunks, chunk_neighbours, truncated, split_documents, semantic_compress, character_vectors, rollup_sources,
    )
}
QUERIES |= {f"emit_{form}": _emitter(form) for form in emit.FORMATS}
QUERIES |= {f"diff_{form}": _formatter(form) for form in diff_output.FORMATS}
