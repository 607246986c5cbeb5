"""Mixing sources to target weights by Poisson replication.

A document of source ``s`` is repeated Poisson(rate of s) times, where the rate
is the tokens that the source shall have over the tokens it has. The number
comes from inverting the distribution at a uniform number hashed from seed and
document, so that it depends on nothing else: not on partitions, order or other
documents. Copies are then put into a global random order by a second hash: as
its values are uniform, equal ranges of them are partitions of equal size, with
no sample of the data, and each is sorted by itself.

All of it is DataFrame expressions. Only one row per source is aggregated and
stored; a source with a third of all rows is pre-aggregated by Spark and joined
as a row of a small table. One number, the bytes to come, goes to the driver. The inverse is exact to the last bit of the uniform number:
each source's cumulative distribution is tabulated until its rest vanishes.

Defined results: a null or wordless text has 0 tokens and the rate of its
source; a null source is a source of its own; a source without tokens or
without a target weight has rate 0; rows with one doc_id and text get equal
numbers; empty tables give empty results. Further columns come through; those
named copy, rate or shuffle_key are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import FILES_PER_CORE, pick, stored, unit_hash

SEED = 20240229
#: Without target weights, sources get weights in proportion to this power of their tokens.
ALPHA = 0.5
#: Text in a partition of the result, about; small results have some partitions for each core.
PARTITION_BYTES = 256 << 20


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cumulative(rate: Column) -> Column:
    """P(X <= k) of Poisson(rate) for k = 0, 1, ... until the rest is below the last bit."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    return F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda a, k: F.struct(
            (a["p"] * rate / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * rate / k)).alias("c")
        ),
        lambda a: a["c"],
    )


def source_rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, tokens, bytes, rate) of each source in ``docs`` (source, text).

    ``weights`` (source, weight) are target shares of all tokens; the total
    stays as it is. Large rates (above 700) are split so that exp() can't vanish:
    the whole part is repeated for certain.
    """
    tokens = (
        pick(docs, source="source", text="text")
        .select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("n"), F.octet_length("text").cast("long").alias("size"))
        .groupBy("source")
        .agg(F.sum("n").alias("tokens"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    )
    tokens = stored(tokens, "tokens")
    if weights is None:
        weighted = tokens.withColumn("weight", F.sqrt("tokens") if alpha == 0.5 else F.pow(F.col("tokens").cast("double"), F.lit(alpha)))
    else:
        own = pick(weights, __source="source", weight="weight").groupBy("__source").agg(F.sum("weight").cast("double").alias("weight"))
        weighted = tokens.join(own, F.col("source").eqNullSafe(F.col("__source")), "left").select(
            "source", "tokens", "bytes", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight")
        )
    # whole millionths, so that the sum is the same in any order
    weighted = weighted.withColumn("weight", F.floor(F.col("weight") * 1e6).cast("decimal(38,0)"))
    total = weighted.filter("tokens > 0").agg(F.sum("tokens").alias("__all"), F.sum("weight").cast("double").alias("__weights"))
    target = F.col("__all").cast("double") * (F.col("weight").cast("double") / F.col("__weights"))
    rate = F.when((F.col("tokens") > 0) & (F.col("__weights") > 0), target / F.col("tokens").cast("double")).otherwise(0.0)
    return weighted.join(F.broadcast(total), F.lit(True), "left").select("source", "tokens", "bytes", rate.alias("rate"))


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, seed: int = SEED, alpha: float = ALPHA, partition_bytes: int = PARTITION_BYTES
) -> DataFrame:
    """``docs`` with each row repeated, and copy (from 0), rate and shuffle_key, in the order of shuffle_key."""
    rates = source_rates(docs, weights, alpha)
    size = rates.agg(F.sum(F.col("bytes") * F.col("rate"))).first()[0] or 0
    parts = max(FILES_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / partition_bytes))
    certain = F.when(F.col("rate") > 700, F.floor("rate")).otherwise(F.lit(0)).cast("long")
    rates = rates.select(
        F.col("source").alias("__source"),
        F.col("rate").alias("__rate"),
        certain.alias("__certain"),
        cumulative(F.col("rate") - certain).alias("__cumulative"),
    )
    names = docs.columns
    at = {n: f"_c{i}" for i, n in reversed(list(enumerate(names)))}
    rows = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    doc = F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit(""))
    uniform = unit_hash(F.lit(f"{seed}-count"), doc)
    times = F.col("__certain") + F.size(F.filter("__cumulative", lambda c: c <= F.col("__uniform")))
    copies = (
        rows.join(rates, F.col(at["source"]).cast("string").eqNullSafe(F.col("__source")))
        .withColumn("__uniform", uniform)
        .withColumn("__times", times)
        .filter("__times > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    )
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), doc, F.col("__copy").cast("string")).cast("binary"))
    added = {"copy": F.col("__copy"), "rate": F.col("__rate"), "shuffle_key": key}
    kept = [F.col(f"_c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in added]
    mixed = copies.select(*kept, *[c.alias(n) for n, c in added.items()])
    place = F.conv(F.substring("shuffle_key", 1, 13), 16, 10).cast("double") / float(1 << 52)
    dealt = mixed.repartitionById(parts, F.floor(place * parts).cast("int"))
    return dealt.sortWithinPartitions("shuffle_key", "copy")
