"""Shared helpers: exact column selection, shared folders, bounded batches."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import shared
from sievework.functions.shared import FILES_PER_CORE

#: ``paths``: those given out in the innermost ``intermediates_removed`` block of the thread.
_GIVEN = threading.local()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (``spark.checkpoint.dir``), deleted when the session's JVM ends; no two calls return the same."""
    path = shared.shared_path(spark, name)
    if getattr(_GIVEN, "paths", None) is not None:
        _GIVEN.paths.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path on any file system that Spark reaches."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def intermediates_removed(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Deletes, at the end of the block, what operators of this thread have stored in it, but for paths in ``keep``.

    Results are lazy and read these tables: write them elsewhere within the
    block. Works on any file system that Spark reaches.
    """
    given: list[str] = []
    outer, _GIVEN.paths = getattr(_GIVEN, "paths", None), given
    try:
        yield
    finally:
        _GIVEN.paths = outer
        for path in given:
            if path not in keep:
                remove(spark, path)


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than some for each core, so that small results don't become thousands of files.

    Partitions are joined without a shuffle and run one after the other within
    a task: all cores stay busy and no task needs more memory.
    """
    return df.coalesce(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared.shared_dir(df.sparkSession))
    return few_files(df).checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    few_files(df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Exactly the named columns, as ``pick(df, new_name="old_name")``.

    Columns are taken by position, so further columns of ``df`` that equal a
    wanted name (also but for case) don't make it ambiguous. An exact match
    wins over one but for case; of several equal ones the first counts.
    """
    names = df.columns
    lower = [n.lower() for n in names]
    chosen = []
    for new, old in wanted.items():
        if old in names:
            at = names.index(old)
        elif old.lower() in lower:
            at = lower.index(old.lower())
        else:
            raise ValueError(f"no column {old!r} among {names}")
        chosen.append((f"_c{at}", new))
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[F.col(a).alias(b) for a, b in chosen])


def text_batches(
    batches: Iterator[pa.RecordBatch], column: str, limit: int
) -> Iterator[pa.Table]:
    """Rows in runs of at most ``limit`` text bytes (at least one row each).

    Small Arrow batches are joined and large ones cut, so that vectorised code
    has enough to do and memory stays bounded by ``limit`` or one single text.
    """
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        lengths = pc.binary_length(table[column]).fill_null(0).to_numpy()
        start = 0
        for row, n in enumerate(lengths):
            if size and size + n > limit:
                if row > start:
                    held.append(table.slice(start, row - start))
                yield pa.concat_tables(held)
                held, size, start = [], 0, row
            size += int(n)
        held.append(table.slice(start))
    if held:
        yield pa.concat_tables(held)


def flat(column: pa.ChunkedArray) -> pa.Array:
    """One array for all chunks."""
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], whole.type)
    return whole


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ``|``.

    52 bits of the digest, so that any engine with MD5 finds the same number.
    """
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def pack(values: np.ndarray) -> bytes:
    """The bytes of an array."""
    return np.ascontiguousarray(values).tobytes()
