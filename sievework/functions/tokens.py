"""Three token estimates, each of its own rounding, and the model table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.tables import MODELS, SPECIAL_CHARACTERS

_BY_NAME = {m[0]: m for m in MODELS}
_SPECIAL = "[" + re.escape(SPECIAL_CHARACTERS).replace("/", r"\/") + "]"
MODEL_SCHEMA = "model string, chars_per_token float, context_window int, vendor string, counts_special boolean, exact boolean"


def models(spark: SparkSession) -> DataFrame:
    """The model table, with the default budget: three quarters of the window, 500,000 at most."""
    budget = F.least(F.floor(F.col("context_window") * 0.75), F.lit(500_000)).cast("int")
    return spark.createDataFrame(MODELS, MODEL_SCHEMA).withColumn("default_budget", budget)


def _float(x: float) -> Column:
    return F.lit(x).cast("float")


def _per_token(size: Column, model: str) -> Column:
    """Bytes over bytes per token, in single precision."""
    return (size.cast("float") / _float(_BY_NAME[model][1])).cast("float")


def scan_estimate(size: Column, model: str) -> Column:
    """Bytes per token, rounded down: what a listing shows."""
    return F.floor(_per_token(size, model)).cast("int")


def quick_estimate(text: Column, model: str) -> Column:
    """Bytes per token, rounded up, 1 at least; 0 for an empty text."""
    tokens = F.ceil(_per_token(F.octet_length(text), model)).cast("int")
    return F.when(text == "", 0).otherwise(F.greatest(tokens, F.lit(1)))


def token_stats(text: Column) -> Column:
    """Bytes, blanks, line ends and special characters of a text: all that estimates need."""
    size = F.octet_length(text)
    without = lambda t, c: F.replace(t, F.lit(c), F.lit(""))
    return F.struct(
        size.alias("bytes"),
        (size - F.octet_length(without(without(text, " "), "\t"))).alias("blanks"),
        (size - F.octet_length(without(text, "\n"))).alias("ends"),
        F.regexp_count(text, F.lit(_SPECIAL)).alias("special"),
    )


def estimate_from(stats: Column, model: str) -> Column:
    """Bytes per token, less for blanks, more for line ends and for some models for special characters; single precision."""
    part = lambda name, weight: (stats[name].cast("float") * _float(weight)).cast("float")
    value = _per_token(stats["bytes"], model)
    value = (value - part("blanks", 0.3)).cast("float")
    value = (value + part("ends", 0.5)).cast("float")
    if _BY_NAME[model][4]:
        value = (value + part("special", 0.3)).cast("float")
    return F.when(stats["bytes"] == 0, 0).otherwise(F.greatest(F.ceil(value).cast("int"), F.lit(1)))


def estimate(text: Column, model: str) -> Column:
    """The estimate of a text; for several models take ``token_stats`` first."""
    return estimate_from(token_stats(text), model)


def estimates(text: Column, names: list[str]) -> Column:
    """A struct of estimates by model; the text is read once."""
    both = F.transform(F.array(token_stats(text)), lambda s: F.struct(*[estimate_from(s, n).alias(n) for n in names]))
    return both[0]


def exceeds(text: Column, model: str, budget: int) -> Column:
    """Whether a text has more tokens than the budget."""
    return estimate(text, model) > budget


def exact_count_udf(vocabulary: str, pattern: str) -> object:
    """A pandas UDF that counts tokens by a byte-pair vocabulary in the rank format, at a path that executors can read.

    The encoder is made once per worker process.
    """

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for s in batches:
            yield s.map(lambda t: 0 if t is None else len(encoder.encode_ordinary(t)))

    return count
