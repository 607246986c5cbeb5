"""The pipeline's stages against brute force, each on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import compression_classifier
from sievework.llm.common import stored
from tests.llm import helpers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """[(name, input, output)]"""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        done = stored(stage(spark, docs, SF), "test-stage")
        out.append((name, docs, done))
        docs = done
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["quality_classifier", "near_duplicates", "substring_dedup", "decontamination", "mixing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
    assert stages[-1][2].columns == [*stages[-1][1].columns, "copy", "rate", "shuffle_key"]


def test_quality_stage(spark, stages):
    _, before, after = stages[0]
    model = compression_classifier.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = compression_classifier.score(before, model).filter(F.col("score") >= compression_classifier.CUT)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in pairs(after))


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    classes = helpers.jaccard(pairs(before))
    assert sorted(d for d, _ in pairs(after)) == sorted({c for _, c, _ in classes})


def test_substring_stage(stages):
    _, before, after = stages[2]
    expected = {d: n for d, _, n, _ in helpers.deduplicated(pairs(before))}
    texts = dict(pairs(before))
    for doc, text in pairs(after):
        assert len(helpers.words(texts[doc])) - len(helpers.words(text)) == expected[doc]
    assert after.filter(F.char_length("text") != F.col("n_chars")).isEmpty()


def test_decontamination_stage(spark, stages):
    _, before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r[0] for r in helpers.contaminated(pairs(before), items) if not r[5]]
    assert sorted(d for d, _ in pairs(after)) == sorted(clean)


def test_mixing_stage(stages):
    _, before, after = stages[4]
    assert {d for d, _ in pairs(after)} <= {d for d, _ in pairs(before)}
    assert after.groupBy("doc_id", "copy").count().filter("count > 1").isEmpty()


def test_run_equals_its_stages(spark, stages):
    before = stages[-1][2]
    whole = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "text", "copy", "rate", "shuffle_key"]
    assert sorted(map(tuple, whole.select(columns).collect())) == sorted(map(tuple, before.select(columns).collect()))


def odd_documents():
    prose = " ".join(helpers.PROSE)
    passage = " ".join(f"shared{i}" for i in range(40))
    return [
        (1, prose + " " + passage, "en", "a"), (2, passage + " tail", "en", None), (3, None, None, "a"), (4, "", "de", "b"), (5, " \n\t", "de", "b"), (6, "one", "en", "a"),
        (6, "one", "en", "a"), (7, "one", "en", "c"), (None, prose, "en", "a"), (None, None, None, None), (8, prose + " " + passage, "fr", "d"),
        (9, " ".join(f"{w}{i % 501}" for i in range(3000) for w in ("long", "text", "here")), "en", "a"),
    ]


def with_further_columns(df):
    return df.select("*", *[F.lit(7).alias(n) for n in ("n_words", "spans", "class_id", "node", "part", "score", "rate", "copy", "__kept", "_removed", "__row", "path")])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_documents(spark, name, stage):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows and clashing further columns."""
    data = odd_documents()
    docs = with_further_columns(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).repartition(3)
    done = stage(spark, docs, SF)
    if name != "mixing":
        assert done.columns == docs.columns
    found = done.collect()
    own = [r for r in found if r["doc_id"] is None or r["text"] is None]
    if name in ("near_duplicates", "decontamination", "substring_dedup"):
        assert len(own) == 3  # both null ids, and the null text
        assert all(r["path"] == r["node"] == r["spans"] == 7 for r in found)
    if name == "near_duplicates":
        classes = {c for _, c, _ in helpers.jaccard([(d, t) for d, t, _, _ in data]) if c is not None}
        assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == sorted(classes)
    if name == "substring_dedup":
        expected = {(d, n) for d, _, n, _ in helpers.deduplicated([(d, t) for d, t, _, _ in data])}
        before = {d: len(helpers.words(t)) for d, t, _, _ in data if d is not None}
        assert {(r["doc_id"], before[r["doc_id"]] - len(helpers.words(r["text"]))) for r in found if r["doc_id"] is not None} == {x for x in expected if x[0] is not None}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_tables(spark, name, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs, SF).count() == 0


def test_results_of_earlier_stages_are_removed(spark):
    from sievework.llm.common import shared_path

    corpus_pipeline.run(spark, SF).count()
    folder = shared_path(spark, "x").rpartition("/")[0]
    names = [p.getPath().getName() for p in spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))]
    assert not [n for n in names if n.startswith(("stage-quality_classifier", "stage-near_duplicates", "stage-substring_dedup", "stage-decontamination"))]
