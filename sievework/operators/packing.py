"""Order-dependent folds over groups of any size, without one task for a group.

Rows are range-partitioned by group and order, so a large group lies in several
parts. Next-fit packing: what a part does to the tokens in use when it starts is
a step function, made for each part at once; composed in order these functions
give every part's true start, and the parts are packed at once again. Budgets:
running sums find where each group's budget ends, and only the rows after that
which could still fit are folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sievework.functions.shared import stored

_PLACES = (1 << 33) - 1


def ranged(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``rows`` as a table with ``__part`` and ``__at``: their places when sorted by group and order over range partitions."""
    by = [*[F.col(g) for g in group], *order]
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id()), "ranged")
    return placed.withColumn("__part", F.shiftrightunsigned("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit(_PLACES))).drop("__id")


def _nexts(sums: np.ndarray, values: np.ndarray, limit: int) -> np.ndarray:
    """For a chunk that starts at each row, where the next one starts."""
    before = sums - values
    return np.maximum(np.searchsorted(sums, before + limit, "right"), np.arange(1, len(sums) + 1))


def _ends(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For a chunk that starts at each row: the chunks from there to the end, and the tokens in the last."""
    n = len(values)
    sums = np.cumsum(values)
    pointer = np.append(_nexts(sums, values, limit), n)
    count, last = np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
    while (pointer[:n] < n).any():  # pointer doubling
        count = count + count[pointer]
        last = np.where(pointer < n, last[pointer], last)
        pointer = pointer[pointer]
    return count[:n], sums[-1] - (sums - values)[last[:n]]


def _step_function(values: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int]]:
    """Of a part that goes on with a chunk: ``above`` (descending), and the chunks added and tokens then used for more than that in use before.

    In use at most the last ``above``, nothing is added and the part's tokens come on top.
    """
    prefix = np.cumsum(values)
    near = int(np.searchsorted(prefix, limit, "right")) + 1  # a later row can't be the first that doesn't fit
    count, used = _ends(values, limit)
    above: list[int] = []
    counts: list[int] = []
    useds: list[int] = []
    for i in np.flatnonzero(values[:near] > 0).tolist():
        own = limit - int(prefix[i])
        if counts and counts[-1] == int(count[i]) and useds[-1] == int(used[i]):
            above[-1] = own
        else:
            above.append(own)
            counts.append(int(count[i]))
            useds.append(int(used[i]))
    return above, counts, useds


_SUMMARY = (
    "__part long, first long, last long, total long, above array<long>, counts array<long>, useds array<long>, fresh_count long, fresh_used long, "
    "last_count long, last_used long"
)


def _summarise(limit: int):
    def summary(table: pa.Table) -> pa.Table:
        table = table.sort_by("__at")
        key, values = table["__key"].to_numpy(), table["__tokens"].to_numpy()
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        first = values[: heads[1]] if len(heads) > 1 else values
        above, counts, useds = _step_function(first, limit)
        count, used = _ends(first, limit)
        last_count, last_used = _ends(values[heads[-1] :], limit)
        row = {
            "__part": table["__part"][0].as_py(), "first": int(key[0]), "last": int(key[-1]) if len(heads) > 1 else None, "total": int(first.sum()), "above": above,
            "counts": counts, "useds": useds, "fresh_count": int(count[0]), "fresh_used": int(used[0]), "last_count": int(last_count[0]), "last_used": int(last_used[0]),
        }
        return pa.Table.from_pylist([row], schema=pa.schema([(n, pa.list_(pa.int64()) if n in ("above", "counts", "useds") else pa.int64()) for n in row]))

    return summary


def _after(part: dict, chunk: int, used: int, limit: int) -> tuple[int, int]:
    """The state after a part's first group that goes on from a state."""
    if used > limit:  # the chunk is one large row; whatever comes starts a new one
        return chunk + part["fresh_count"], part["fresh_used"]
    for above, count, left in zip(part["above"], part["counts"], part["useds"], strict=True):
        if used > above:
            return chunk + count, left
    return chunk, used + part["total"]


def starts_of(parts: list[dict], limit: int) -> dict[int, tuple[int, int]]:
    """(chunk, tokens in use) with which each part's first group starts; (-1, 0): anew."""
    state: tuple[int | None, int, int] = (None, -1, 0)
    out = {}
    for part in sorted(parts, key=lambda p: p["__part"]):
        goes_on = state[0] == part["first"]
        chunk, used = state[1:] if goes_on else (-1, 0)
        out[part["__part"]] = chunk, used
        if part["last"] is not None:
            state = part["last"], part["last_count"] - 1, part["last_used"]
        elif goes_on:
            state = part["first"], *_after(part, chunk, used, limit)
        else:
            state = part["first"], part["fresh_count"] - 1, part["fresh_used"]
    return out


def packed_from(values: np.ndarray, limit: int, chunk: int, used: int) -> tuple[np.ndarray, int, int]:
    """Chunk numbers of a run of rows from a state, and the state after it."""
    sums = np.cumsum(values)
    out = np.zeros(len(values), np.int64)
    at = 0 if chunk < 0 or used > limit else int(np.searchsorted(sums, limit - used, "right"))
    starts = []
    while at < len(values):
        starts.append(at)
        at = max(int(np.searchsorted(sums, limit + int(sums[at] - values[at]), "right")), at + 1)
    out[starts] = 1
    if starts:
        used = int(sums[-1] - sums[starts[-1]] + values[starts[-1]])
    elif len(values):
        used += int(sums[-1])
    return chunk + np.cumsum(out), chunk + len(starts), used


def _pack(starts, limit: int, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, state = None, None, (-1, 0)
        for batch in batches:
            parts, keys, values = (batch.column(n).to_numpy() for n in ("__part", "__key", "__tokens"))
            chunks = np.zeros(len(parts), np.int64)
            heads = np.flatnonzero(np.append(True, (parts[1:] != parts[:-1]) | (keys[1:] != keys[:-1]))) if len(parts) else np.zeros(0, np.int64)
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(parts)], strict=True):
                if parts[a] != now:
                    now, key, state = int(parts[a]), int(keys[a]), starts.value[int(parts[a])]
                elif keys[a] != key:
                    key, state = int(keys[a]), (-1, 0)
                chunks[a:b], *after = packed_from(values[a:b], limit, *state)
                state = tuple(after)
            kept = [batch.column(n) for n in arrow.names[:-1]]
            yield pa.record_batch([*kept, pa.array(chunks)], schema=arrow)

    return run


def next_fit(rows: DataFrame, group: list[str], order: list[Column], tokens: str, limit: int, keep: list[str]) -> DataFrame:
    """(group, keep, chunk): each group's rows in order, packed next-fit into chunks of ``limit`` tokens; a larger row is alone.

    The driver holds one step function for each part, whose size is the number
    of different outcomes of a part, at most the rows of a chunk.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [*dict.fromkeys([*group, *keep])]
    coded = rows.withColumn("__key", F.xxhash64(*group)).withColumn("__tokens", F.col(tokens).cast("long"))
    placed = ranged(coded, group, order)
    narrow = placed.select("__part", "__at", "__key", "__tokens")
    parts = [r.asDict() for r in narrow.groupBy("__part").applyInArrow(_summarise(limit), _SUMMARY).collect()]
    starts = rows.sparkSession.sparkContext.broadcast(starts_of(parts, limit))
    schema = T.StructType([*placed.select(*names).schema.fields, T.StructField("chunk", T.LongType())])
    ordered = placed.repartition("__part").sortWithinPartitions("__part", "__at").select(*names, "__part", "__key", "__tokens")
    return ordered.mapInArrow(_pack(starts, limit, to_arrow_schema(schema)), schema)


def running_sums(placed: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``placed`` (of ``ranged``) with the sum of ``value`` over each group's rows up to each."""
    own = Window.partitionBy("__part", *group).orderBy("__at")
    parts = placed.groupBy("__part", *group).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("__part", *group, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    joined = placed.join(before.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in group], "__before"), _same(group))
    return joined.withColumn(name, F.col("__before") + F.sum(value).over(own)).drop("__p", "__before", *[f"__g_{g}" for g in group])


def _same(group: list[str]) -> Column:
    same = F.col("__part") == F.col("__p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return same


def within_budget(rows: DataFrame, group: list[str], order: list[Column], key: str, tokens: str, room: int, least: int) -> DataFrame:
    """(group, key, action, used): in order keep what fits ``room``; what doesn't is truncated into what is left if that is over ``least``, else dropped.

    Only rows after the end of a budget that are no larger than what was left there, at most ``least`` tokens, are folded in one task for each group.
    """
    from sievework.operators.corpus import fold_in_order

    needed = [*dict.fromkeys([*group, key, *(c for c in rows.columns if c != tokens)])]
    sorted_rows = ranged(rows.select(*needed, F.col(tokens).cast("long").alias("__tokens")), group, order)
    placed = running_sums(sorted_rows.select(*group, key, "__tokens", "__part", "__at"), group, "__tokens", "__total")
    place = F.struct("__part", "__at")
    ends = placed.filter(F.col("__total") > room).groupBy(*group).agg(F.min(F.struct(place.alias("place"), (F.col("__total") - F.col("__tokens")).alias("used"))).alias("end"))
    named = ends.select(*[F.col(g).alias(f"__g_{g}") for g in group], "end")
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    joined = placed.join(named, same, "left").drop(*[f"__g_{g}" for g in group])
    left = F.lit(room) - F.col("end.used")
    cuts = F.col("end.used") + least < room
    early = F.col("end").isNull() | (place < F.col("end.place"))
    at_end = place == F.col("end.place")
    action = F.when(early, "keep").when(at_end & cuts, "truncate").when(at_end, "drop").when(cuts & (F.col("__tokens") == 0), "keep").when(cuts | (F.col("__tokens") > left), "drop")
    judged = joined.withColumn("action", action)
    used = F.when(F.col("action") == "keep", F.col("__tokens")).when(F.col("action") == "truncate", left).otherwise(F.lit(0)).cast("long")
    done = judged.filter("action IS NOT NULL").select(*group, key, "action", used.alias("used"))
    rest = judged.filter("action IS NULL").select(*group, key, "__part", "__at", F.struct("__tokens", left.alias("left")).alias("value"))

    def step(free: int | None, value: dict) -> tuple:
        free = value["left"] if free is None else free
        return (free - value["__tokens"], ("keep", value["__tokens"])) if value["__tokens"] <= free else (free, ("drop", 0))

    small = fold_in_order(rest, group, [F.col("__part"), F.col("__at")], [key], "value", lambda: None, step, "action string, used long")
    return done.unionByName(small)

