"""Incremental state: manifests, collisions, caches, audit chains."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.text import content_hash
from sievework.operators.graph import cut


def manifest_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(location_key, full_hash) of each row."""
    return rows.select(F.col(key).cast("string").alias("location_key"), content_hash(F.col(text)).alias("full_hash"))


def manifest_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(location_key, status): added, removed, modified or unchanged, by hash."""
    old = previous.select("location_key", F.col("full_hash").alias("old_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("full_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("full_hash"), "modified")
        .otherwise("unchanged")
    )
    both = current.select("location_key", "full_hash").join(old, "location_key", "full_outer")
    return both.select("location_key", status.alias("status"))


def upserts(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("status").isin("added", "modified"))


def deletes(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("status") == "removed")


def numbered(rows: DataFrame, order: list, name: str = "number") -> DataFrame:
    """``rows`` with their place, from 0, in a total order of column names or expressions.

    Places come from a range sort and per-partition counts, so no single task
    orders all rows.
    """
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    placed = ranged.withColumn("__part", F.shiftrightunsigned("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # one row per partition
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = placed.join(F.broadcast(before.select("__part", "__before")), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__id", "__at", "__before")


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``rows`` with the number of their batch of ``size`` in a total order."""
    return numbered(rows, order, "__place").withColumn("batch", F.floor(F.col("__place") / size)).drop("__place")


def collisions(rows: DataFrame, id: str = "chunk_id", full_hash: str = "full_hash") -> DataFrame:
    """Ids that stand for more than one hash."""
    return rows.groupBy(id).agg(F.count_distinct(full_hash).alias("hashes")).filter("hashes > 1")


def duplicates(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(hash, n, first): contents that occur more than once."""
    return rows.groupBy(content_hash(text).alias("hash")).agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")


def entries_checksum(manifest: DataFrame) -> DataFrame:
    """One row: a checksum of all entries that doesn't depend on their order.

    Sums of the entries' own digests, so it is a plain aggregation at any size.
    """
    digest = F.sha2(F.concat_ws("\0", "location_key", "full_hash").cast("binary"), 256)
    part = lambda k: F.sum(F.conv(F.substring(digest, k, 8), 16, 10).cast("decimal(38,0)"))
    return manifest.agg(F.count("*").alias("entries"), F.sha2(F.concat_ws("-", *[part(k) for k in (1, 9, 17, 25)]).cast("binary"), 256).alias("checksum"))


def settings_hash(settings: dict) -> str:
    """A hash of settings that doesn't depend on their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def settings_match(first: dict, second: dict) -> bool:
    """Whether two runs may share a manifest."""
    return settings_hash(first) == settings_hash(second)


def manifest_checksum(manifest: DataFrame, settings: dict | None = None) -> DataFrame:
    """One row (entries, checksum) over all entries and the settings that made them."""
    entries = entries_checksum(manifest)
    if settings is None:
        return entries
    return entries.withColumn("checksum", F.sha2(F.concat(F.lit(settings_hash(settings)), F.col("checksum")).cast("binary"), 256))


def save_manifest(manifest: DataFrame, path: str, settings: dict | None = None) -> None:
    """The manifest, its settings and its checksum as Parquet below a path."""
    spark = manifest.sparkSession
    manifest.write.mode("overwrite").parquet(f"{path}/entries")
    told = spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "settings string")
    told.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    manifest_checksum(spark.read.parquet(f"{path}/entries"), settings).write.mode("overwrite").parquet(f"{path}/checksum")


def load_manifest(spark: SparkSession, path: str, settings: dict | None = None) -> DataFrame:
    """A saved manifest; an error if its checksum is wrong, or if it was made with other settings than those given."""
    entries = spark.read.parquet(f"{path}/entries")
    saved = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    if manifest_checksum(entries, saved).first() != spark.read.parquet(f"{path}/checksum").first():
        raise ValueError(f"the manifest at {path} is damaged")
    if settings is not None and not settings_match(settings, saved or {}):
        raise ValueError(f"the manifest at {path} was made with other settings")
    return entries


#: Phases of a resumable run, in order.
PHASES = ("discovery", "chunking", "call_graph", "hierarchy", "sorting", "complete")


def save_checkpoint(spark: SparkSession, path: str, phase: str, processed: DataFrame, settings: dict | None = None) -> None:
    """Where a run is: its phase and the files (path) that it has done, with a hash of all."""
    if phase not in PHASES:
        raise ValueError(f"no phase {phase!r}")
    processed.select("path").distinct().write.mode("overwrite").parquet(f"{path}/processed")
    own = entries_checksum(spark.read.parquet(f"{path}/processed").select(F.col("path").alias("location_key"), F.lit("").alias("full_hash"))).first()["checksum"]
    row = (phase, settings_hash(settings or {}), hashlib.sha256(f"{phase}|{settings_hash(settings or {})}|{own}".encode()).hexdigest())
    spark.createDataFrame([row], "phase string, settings string, hash string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")


def load_checkpoint(spark: SparkSession, path: str, settings: dict | None = None) -> tuple[str, DataFrame]:
    """(phase, processed files) of a run; an error if it is damaged or of other settings."""
    state, processed = spark.read.parquet(f"{path}/state").first(), spark.read.parquet(f"{path}/processed")
    own = entries_checksum(processed.select(F.col("path").alias("location_key"), F.lit("").alias("full_hash"))).first()["checksum"]
    if hashlib.sha256(f"{state['phase']}|{state['settings']}|{own}".encode()).hexdigest() != state["hash"]:
        raise ValueError(f"the checkpoint at {path} is damaged")
    if state["settings"] != settings_hash(settings or {}):
        raise ValueError(f"the checkpoint at {path} is of other settings")
    return state["phase"], processed


# Kinds of audit events.
AUDIT_EVENTS = [
    "scan_started", "scan_completed", "scan_failed", "secret_detected", "pii_detected", "secret_redacted", "license_violation", "chunk_generated",
    "chunk_split", "chunk_skipped", "manifest_created", "manifest_updated", "manifest_diff_computed", "access_denied", "path_traversal_blocked",
    "config_loaded", "config_changed", "data_exported", "data_transmitted",
]


def chained_audit(events: DataFrame, group: str) -> DataFrame:
    """Events (group, seq, event, detail) of known kinds with ``prev_hash`` and ``hash``, a chain for each group in order of seq.

    A hash covers all before it, so a group is one ordered pass with one hash in memory.
    """
    from sievework.operators.corpus import fold_in_order

    known = events.filter(F.col("event").isin(AUDIT_EVENTS))
    coded = known.withColumn("value", F.to_json(F.struct("seq", "event", "detail")))

    def step(before: str, value: str) -> tuple:
        own = hashlib.sha256(f"{before}|{value}".encode()).hexdigest()
        return own, (before, own)

    return fold_in_order(coded, [group], [F.col("seq")], ["seq", "event", "detail"], "value", lambda: "", step, "prev_hash string, hash string")


def append_audit(events: DataFrame, path: str) -> None:
    """Events as lines of JSON, appended."""
    events.write.mode("append").json(path)


def pending(files: DataFrame, processed: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Files (path) that a resumed run has still to do: neither processed nor failed."""
    left = files.join(processed.select("path"), "path", "left_anti")
    return left if failed is None else left.join(failed.select("path"), "path", "left_anti")


def needs_rescan(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, mtime, size, hash) that the cache lacks or has with another time, size or hash."""
    old = cache.select("path", F.col("mtime").alias("m"), F.col("size").alias("s"), F.col("hash").alias("h"), F.lit(True).alias("known"))
    same = F.col("m").eqNullSafe(F.col("mtime")) & F.col("s").eqNullSafe(F.col("size")) & F.col("h").eqNullSafe(F.col("hash"))
    return files.join(old, "path", "left").filter(F.col("known").isNull() | ~same).select(*files.columns)


def deleted_files(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cache entries whose file is gone."""
    return cache.join(files.select("path"), "path", "left_anti")


def verify_chain(log: DataFrame, group: list[str] = (), order: str = "seq") -> DataFrame:
    """Audit entries (seq, prev_hash, hash) whose ``prev_hash`` isn't the hash before; the first has none or an empty one.

    Logs of groups are checked by a window; one log of all rows by its places, which are joined with the place before.
    """
    broken = F.coalesce("prev_hash", F.lit("")) != F.coalesce("__before", F.lit(""))
    if group:
        before = F.lag("hash").over(Window.partitionBy(*group).orderBy(order))
        return log.withColumn("__before", before).filter(broken).drop("__before")
    placed = numbered(log, [order], "__place")
    previous = placed.select((F.col("__place") + 1).alias("__place"), F.col("hash").alias("__before"))
    return placed.join(previous, "__place", "left").filter(broken).drop("__place", "__before")


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, end, n): runs of events with pauses of less than ``gap``."""
    per = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return per.select(key, "start", "end", "n")


def recent_counts(rows: DataFrame, key: str, ts: str, days: int) -> DataFrame:
    """(key, total, recent, age_days): rows in all and in the last ``days`` before the newest of all, and days since the newest of the key."""
    newest = rows.agg(F.max(ts).alias("__now"))
    near = F.col(ts) >= F.col("__now") - F.make_dt_interval(F.lit(days))
    per = rows.crossJoin(F.broadcast(newest)).groupBy(key).agg(  # one row
        F.count("*").alias("total"), F.count_if(near).alias("recent"), F.datediff(F.max("__now"), F.max(ts)).alias("age_days")
    )
    return per
