"""From raw documents to a training mixture: five stages, each one operator of ``sievework.llm``.

Every stage takes all that its predecessor kept and returns the columns of
``documents``; the last adds copy, rate and shuffle_key. Each result is written
as Parquet to the shared folder and read again, so that a lost executor costs
tasks of one stage at most, and a stage's own tables and its predecessor's
result are removed once its own result is stored.

Defined results: a null or empty text is scored like any other, is alone in its
class, loses no words, is never contaminated, and is repeated at its source's
rate; a row with a null doc_id stays until the last stage, where it is repeated
like any other; of rows equal in doc_id and text one stays; a null source is a
source of its own; documents of equal score, similarity or window stay or go by
the least doc_id; an empty table gives an empty result at every stage; further
columns, also those named like results or columns of a stage, come through
unchanged, but copy, rate and shuffle_key are the last stage's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import compression_classifier, decontamination, jaccard_join, mixing, substring_dedup
from sievework.llm.common import intermediates_removed, remove, shared_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    model = compression_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compression_classifier.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join stays: that with the least doc_id."""
    return jaccard_join.keep_one_of_each(docs)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that earlier documents have go; a document may be left with an empty text."""
    names = docs.columns
    own = [f"_c{i}" for i in range(len(names))]  # by position, as further columns may be named like the operator's
    done = substring_dedup.dedup_substrings(docs, carry=True).toDF(*own, "_words", "_removed", "_spans")
    if "n_chars" in names:
        size = own[names.index("n_chars")]
        left = F.char_length(own[names.index("text")]).cast("long")
        done = done.withColumn(size, F.when(F.col("_removed") > 0, left).otherwise(F.col(size).cast("long")))
    return done.select(own).toDF(*names)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to their source's target share and shuffled globally."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_deduplication),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
]

#: Stages 1, 2 and 5's input can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with intermediates_removed(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
