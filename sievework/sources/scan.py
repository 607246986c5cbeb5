"""Files, repositories, diffs and archives of histories as DataFrames."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from sievework.functions.text import lines
from sievework.functions.tokens import estimate, scan_estimate
from sievework.operators.corpus import filter_paths, is_binary, language_of, pack_chunks

# Extensions of binary files.
BINARY_EXTENSIONS = [
    "exe", "dll", "so", "dylib", "o", "a", "lib", "bin", "class", "pyc", "jar", "war", "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "png", "jpg",
    "jpeg", "gif", "bmp", "ico", "webp", "tiff", "svgz", "mp3", "mp4", "avi", "mov", "mkv", "wav", "flac", "ogg", "webm", "pdf", "doc", "docx",
    "xls", "xlsx", "ppt", "pptx", "ttf", "otf", "woff", "woff2", "eot", "db", "sqlite", "sqlite3", "wasm",
]
# Paths that a scan leaves out unless told otherwise.
DEFAULT_IGNORES = [
    "node_modules", "vendor", ".git", ".hg", ".svn", "target", "dist", "build", "out", ".next", ".nuxt", "__pycache__", ".venv", "venv", ".tox",
    ".mypy_cache", ".pytest_cache", ".cache", "coverage", ".idea", ".vscode", "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json",
    "*.pyc", "*.log", ".DS_Store",
]
#: Lines of a file are taken to have so many bytes where nobody counts them.
BYTES_PER_LINE = 40


def read_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = 50 << 20, ignores: list[str] = DEFAULT_IGNORES) -> DataFrame:
    """(path, size_bytes, modified, language, content) of the text files below a folder.

    Paths and sizes are filtered on the listing, before any content is read.
    """
    root = path.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = raw.select(
        F.regexp_replace(F.col("path"), r"^.*?" + root.split("://")[-1].replace(".", r"\.") + "/", "").alias("path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
        "content",
    )
    kept = filter_paths(rows.filter(F.col("size_bytes") <= max_bytes), exclude=list(ignores))
    named = kept.filter(~F.coalesce(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(BINARY_EXTENSIONS), F.lit(False)))
    text = named.filter(~is_binary(F.col("content")))
    return text.select("path", "size_bytes", "modified", language_of(F.col("path")).alias("language"), F.col("content").cast("string").alias("content"))


#: Ways to scan: ``accurate`` counts tokens and reads symbols, ``fast`` estimates both from sizes and reads no content.
PRESETS = {
    "fast": {"contents": False, "symbols": False, "pipeline_files": 100, "batch_files": 5000},
    "accurate": {"contents": True, "symbols": True, "pipeline_files": 100, "batch_files": 5000},
}


def scan(spark: SparkSession, path: str, preset: str = "accurate", model: str = "claude", **more: object) -> DataFrame:
    """Files below a folder by a preset: path, size_bytes, modified, language, tokens; with contents also content, and with symbols their number.

    ``fast`` prunes the content column, so that only the listing is read.
    """
    settings = PRESETS[preset] | {k: more.pop(k) for k in list(more) if k in PRESETS[preset]}
    if not settings["contents"]:
        rows = listed_files(spark, path, **more)
        return rows.withColumn("tokens", scan_estimate(F.col("size_bytes"), model))
    rows = read_files(spark, path, **more).withColumn("tokens", estimate(F.col("content"), model))
    if not settings["symbols"]:
        return rows
    from sievework.sources import code

    counts = code.parse_symbols(rows).groupBy(F.col("file").alias("path")).agg(F.count("*").alias("symbols"))
    return rows.join(counts, "path", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))


def listed_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = 50 << 20, ignores: list[str] = DEFAULT_IGNORES) -> DataFrame:
    """(path, size_bytes, modified, language) of the files below a folder; no content is read, so binary files are told by extension only."""
    root = path.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    bare = F.regexp_replace(F.col("path"), r"^.*?" + root.split("://")[-1].replace(".", r"\.") + "/", "")
    rows = raw.select(bare.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    kept = filter_paths(rows.filter(F.col("size_bytes") <= max_bytes), exclude=list(ignores))
    named = kept.filter(~F.coalesce(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(BINARY_EXTENSIONS), F.lit(False)))
    return named.withColumn("language", language_of(F.col("path")))


def file_pieces(spark: SparkSession, path: str, piece_bytes: int = 1 << 20) -> DataFrame:
    """(path, piece, size, tokens): the pieces of each file of a folder, for files too large to be one row.

    Files are streamed line by line by Spark's text reader and packed into
    pieces of about ``piece_bytes``; a longer line is a piece of its own.
    """
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"),
        (F.octet_length("value") + 1).cast("long").alias("size"),
    )
    packed = pack_chunks(rows, ["path"], ["block", "n"], "size", piece_bytes, "n", split=True).withColumnRenamed("chunk", "piece")
    sized = packed.groupBy("path", "piece").agg(F.sum("size").alias("size"))
    return sized.withColumn("tokens", scan_estimate(F.col("size"), "claude"))


def listing(files: DataFrame) -> DataFrame:
    """Files without contents, with estimated lines."""
    return files.drop("content").withColumn("lines", F.floor(F.col("size_bytes") / BYTES_PER_LINE).cast("long"))


def tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """(folder, files, bytes) of every folder down to a depth; each file counts in all folders above it."""
    parts = F.slice(F.split("path", "/"), 1, depth)
    deep = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - F.when(F.size(F.split("path", "/")) <= depth, 1).otherwise(0), F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    inside = files.filter(F.contains("path", F.lit("/"))).select(F.explode(deep).alias("folder"), "size_bytes")
    return inside.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def diff_lines(diffs: DataFrame, key: str = "key", diff: str = "diff") -> DataFrame:
    """(key, hunk, kind, old_line, new_line, text) of unified diffs.

    Line numbers run with window sums from each hunk's header; a diff's lines
    are one partition of the window.
    """
    rows = diffs.select(key, F.posexplode(lines(F.col(diff))).alias("at", "line"))
    rows = rows.filter(~F.col("line").rlike(r"^(?:diff |index |--- |\+\+\+ |\\)"))
    header = r"^@@ -([0-9]+)(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@"
    is_head = F.col("line").rlike(header)
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hunk", F.sum(is_head.cast("int")).over(upto)).filter("hunk > 0")
    inside = Window.partitionBy(key, "hunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    start = lambda group: F.first(F.when(is_head, F.regexp_extract("line", header, group).cast("int")), True).over(inside)
    mark = F.substring("line", 1, 1)
    kind = F.when(mark == "+", "add").when(mark == "-", "remove").otherwise("context")
    rows = rows.withColumn("kind", F.when(~is_head, kind)).withColumn("old0", start(1)).withColumn("new0", start(2))
    old = F.col("old0") + F.sum(F.col("kind").isin("context", "remove").cast("int")).over(inside) - 1
    new = F.col("new0") + F.sum(F.col("kind").isin("context", "add").cast("int")).over(inside) - 1
    numbered = rows.withColumn("o", old).withColumn("n", new).filter(F.col("kind").isNotNull())
    return numbered.select(
        key, "hunk", "kind",
        F.when(F.col("kind") != "add", F.col("o")).alias("old_line"),
        F.when(F.col("kind") != "remove", F.col("n")).alias("new_line"),
        F.substr("line", F.lit(2)).alias("text"),
    )


def remote_parts(url: Column) -> Column:
    """(provider, owner, name, branch) of a repository's URL or ``provider:owner/name`` shorthand; null if it is none."""
    clean = F.regexp_replace(F.trim(url), r"\.git/?$|/$", "")
    shape = r"^(?:https?://|git@|ssh://git@)?(github|gitlab|bitbucket)(?:\.(?:com|org))?[:/]([^/\s]+)/([^/\s@#]+)(?:/tree/([^\s]+)|@([^\s]+))?"
    part = lambda k: F.nullif(F.regexp_extract(clean, shape, k), F.lit(""))
    made = F.struct(part(1).alias("provider"), part(2).alias("owner"), part(3).alias("name"), F.coalesce(part(4), part(5)).alias("branch"))
    return F.when(clean.rlike(shape), made)


def contracts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, package, kind, name) of services, rpcs, messages and enums in protobuf files."""
    body = F.regexp_replace(content, r"(?s)/\*.*?\*/|//[^\n]*", "")
    package = F.regexp_extract(body, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    found = [
        F.transform(F.regexp_extract_all(body, F.lit(rf"\b{kind}\s+(\w+)"), F.lit(1)), _named(kind)) for kind in ("service", "rpc", "message", "enum")
    ]
    rows = files.filter(F.col(path).endswith(".proto"))
    return rows.select(path, package.alias("package"), F.explode(F.concat(*found)).alias("c")).select(path, "package", "c.kind", "c.name")


def _named(kind: str):
    return lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))


class GitLog(DataSource):
    """``spark.read.format("git_log").option("repository", folder)``: one row per commit and changed file.

    The repository must be readable where the task runs; ranges of commits are read by several tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "hash string, author string, email string, ts timestamp, message string, status string, path string"

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.repository = options.get("repository", ".")
        self.tasks = int(options.get("tasks", "1"))

    def _git(self, *arguments: str) -> str:
        return subprocess.run(["git", "-c", "safe.directory=*", "-C", self.repository, *arguments], capture_output=True, text=True, check=True).stdout

    def partitions(self) -> list[InputPartition]:
        n = int(self._git("rev-list", "--count", "HEAD").strip() or 0)
        step = max(1, -(-n // self.tasks))
        return [InputPartition((skip, step)) for skip in range(0, n, step)]

    def read(self, partition) -> Iterator[tuple]:
        from datetime import datetime, timezone

        skip, count = partition.value
        text = self._git("log", f"--skip={skip}", f"-n{count}", "--name-status", "--format=%x01%H%x02%an%x02%ae%x02%at%x02%s")
        for commit in text.split("\x01")[1:]:
            head, _, files = commit.partition("\n")
            sha, author, email, ts, message = head.split("\x02")
            when = datetime.fromtimestamp(int(ts), timezone.utc).replace(tzinfo=None)
            for line in filter(None, files.split("\n")):
                status, *paths = line.split("\t")
                yield sha, author, email, when, message, status[:1], paths[-1]


def git_log(spark: SparkSession, repository: str, tasks: int = 1) -> DataFrame:
    spark.dataSource.register(GitLog)
    return spark.read.format("git_log").option("repository", repository).option("tasks", str(tasks)).load()


def file_history(log: DataFrame, days: int = 90) -> DataFrame:
    """(path, commits, recent, authors, last_hash, age_days) relative to the newest commit of all."""
    newest = log.agg(F.max("ts").alias("now"))
    near = F.col("ts") >= F.col("now") - F.make_dt_interval(F.lit(days))
    return log.crossJoin(F.broadcast(newest)).groupBy("path").agg(  # one row
        F.count("*").alias("commits"), F.count_if(near).alias("recent"), F.array_sort(F.collect_set("author")).alias("authors"),
        F.max_by("hash", "ts").alias("last_hash"), F.datediff(F.max("now"), F.max("ts")).alias("age_days"),
    )
