"""A map of a code base: ranked symbols, modules, an index of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import chunking, corpus, graph, rank

#: Tokens that a listed symbol, a listed file and the frame take.
SYMBOL_TOKENS, FILE_TOKENS, FRAME_TOKENS = 25, 10, 100
#: Accessors that say nothing about a code base.
GENERIC_NAMES = ["new", "get", "set", "default", "clone", "from", "into", "len", "iter", "next"]


def ranked_symbols(symbols: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` symbols (symbol_id, name, kind) by rank over edges (src, dst) of ids; imports and generic accessors left out."""
    ranks = graph.map_pagerank(edges, symbols.select(F.col("symbol_id").alias("node")))
    entry = F.when(F.col("name").rlike("^(?:main|run|start|handle)"), 1.5).otherwise(1.0)
    rows = symbols.join(ranks, symbols["symbol_id"] == ranks["node"]).filter((F.col("kind") != "import") & ~F.col("name").isin(GENERIC_NAMES))
    scored = rows.withColumnRenamed("rank", "pagerank").drop("node")
    return corpus.top_n(scored, F.col("pagerank") * entry, "symbol_id", most)


def file_index(files: DataFrame) -> DataFrame:
    """(path, importance, bucket) of files (path, symbols)."""
    scored = files.withColumn("importance", rank.file_importance(F.col("path"), F.col("symbols").cast("double")))
    return scored.select("path", "importance", rank.importance_bucket(F.col("importance")).alias("bucket"))


def repo_map(symbols: DataFrame, edges: DataFrame, files: DataFrame, budget: int = 2000) -> dict[str, DataFrame]:
    """``symbols``, ``modules``, ``module_edges`` and ``files`` of a map within a token budget."""
    most = min(500, max(5, budget // 20))
    top = ranked_symbols(symbols, edges, most)
    module = symbols.select("symbol_id", chunking.module_of(F.col("file")).alias("module"))
    named = edges.join(module.withColumnRenamed("symbol_id", "src"), "src").withColumnRenamed("module", "src_module")
    named = named.join(module.withColumnRenamed("symbol_id", "dst"), "dst").withColumnRenamed("module", "dst_module")
    links = named.filter("src_module != dst_module").groupBy("src_module", "dst_module").agg(F.count("*").alias("weight"))
    room = (budget - SYMBOL_TOKENS * most - FRAME_TOKENS) // FILE_TOKENS
    index = file_index(files)
    order = F.when(F.col("bucket") == "critical", 0).when(F.col("bucket") == "high", 1).when(F.col("bucket") == "normal", 2).otherwise(3)
    listed = index.orderBy(order, "path").limit(room) if room > 0 else index
    modules = files.groupBy(chunking.module_of(F.col("path")).alias("module")).agg(F.count("*").alias("files"), F.sum("symbols").alias("symbols"))
    return {"symbols": top, "modules": modules, "module_edges": links, "files": listed}
