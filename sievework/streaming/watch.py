"""Structured Streaming: watching documents and keeping a manifest, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.functions.text import content_hash
from sievework.operators import distill, state
from sievework.plans import embed


def watch_documents(spark: SparkSession, folder: str, schema: str, max_files: int = 1000) -> DataFrame:
    """A stream of the rows of new Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def distilled(stream: DataFrame) -> DataFrame:
    """The stateless stages over a stream of documents: blocks that aren't worthless."""
    return distill.strip(distill.line_blocks(stream))


def _versions(spark: SparkSession, manifest: str) -> list[int]:
    """Numbers of the versions below a folder, newest last."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [f.getPath().getName() for f in files.listStatus(place)]
    whole = [n for n in names if n.startswith("v=") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{manifest}/{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in whole)


def keep_manifest(
    stream: DataFrame, manifest: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, deleted: str | None = None
) -> StreamingQuery:
    """Upserts (doc_id, text) batches into a manifest of Parquet versions, one folder per batch.

    Each batch is compared with the newest version before its own; added,
    modified and removed rows (location_key, status) go to ``then``. ``deleted``
    names a boolean column of the stream: rows in which it is true take their
    document out. A batch that is run again writes the same folder again, so
    the result is the same after a failure; of versions the last two are kept.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        gone = F.col(deleted) if deleted else F.lit(False)
        newest = batch.groupBy("doc_id").agg(F.max(F.struct((~gone).alias("there"), "text")).alias("m"))
        current = state.manifest_of(newest.filter("m.there").select("doc_id", F.col("m.text").alias("text")), "doc_id", "text")
        removed = newest.filter("NOT m.there").select(F.col("doc_id").cast("string").alias("location_key"))
        older = [v for v in _versions(spark, manifest) if v < number]
        previous = spark.read.parquet(f"{manifest}/v={older[-1]}") if older else current.limit(0)
        diff = state.manifest_diff(current, previous).filter("status IN ('added', 'modified')").select("location_key", "status")
        out = removed.join(previous.select("location_key"), "location_key", "left_semi").withColumn("status", F.lit("removed"))
        touched = current.select("location_key").unionByName(removed)
        kept = previous.join(touched, "location_key", "left_anti").unionByName(current)
        kept.write.mode("overwrite").parquet(f"{manifest}/v={number}")
        if then is not None:
            then(diff.unionByName(out), number)
        for version in older[:-1]:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{manifest}/v={version}")
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    return (
        stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    """The newest version that ``keep_manifest`` has written."""
    return spark.read.parquet(f"{manifest}/v={_versions(spark, manifest)[-1]}")


def embed_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, batch_files: int = 500, limit: int = 1000) -> StreamingQuery:
    """Chunks of new Parquet files of code (path, language, content) in ``folder``, batch by batch, as Parquet in ``out``/batch=N.

    Memory is bounded by a batch. What needs all chunks (merged aliases, links
    between repositories) runs afterwards over ``out``.
    """
    files = spark.readStream.schema("path string, language string, content string").option("maxFilesPerTrigger", batch_files).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        embed.chunks(batch, limit=limit).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cancel(query: StreamingQuery) -> None:
    """Stops a stream after the batch at hand; a later start goes on where it stopped."""
    query.stop()


def debounced(events: DataFrame, key: str, ts: str, pause: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One row per burst of events of a key: a session window with a watermark."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, pause).alias("w")).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def first_seen(stream: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    """Documents whose content hasn't come within the watermark's time."""
    hashed = stream.withColumn("content_hash", content_hash(F.col("text"))).withWatermark(ts, late)
    return hashed.dropDuplicatesWithinWatermark(["content_hash"])


def progress(query: StreamingQuery) -> list[dict]:
    """Rows in and time of each finished batch."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["batchDuration"]} for p in map(dict, query.recentProgress)]


def totals(query: StreamingQuery) -> dict:
    """Batches, rows and milliseconds of a stream so far, whether it still runs, and its error, if any."""
    done = progress(query)
    error = query.exception()
    return {
        "batches": len(done), "rows": sum(p["rows"] for p in done), "ms": sum(p["ms"] for p in done), "active": query.isActive,
        "error": None if error is None else str(error),
    }
