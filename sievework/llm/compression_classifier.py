"""Quality classifier by compression with two zstandard dictionaries.

One dictionary is trained on texts labelled good, one on texts labelled bad. A
text is cut into pieces of ``PIECE`` bytes, all of which are compressed with
either dictionary; with the summed sizes ``g`` and ``b`` the normalised
difference ``(b - g) / (b + g)`` is high for good texts. A logistic curve,
fitted on labelled texts that the dictionaries haven't seen and weighted by the
labels' true frequencies, turns it into a probability.

Fitting takes at most ``sample_rows`` labelled texts of each class, those with
the least hashes of their doc_id (found from the ids alone); seven tenths of
them teach the dictionaries, the others the curve. A dictionary is trained on
at most ``pieces`` pieces, those with the least hashes among all pieces of its
whole texts. The curve's texts are compressed whole, on the executors. So the
driver holds ids, pieces and one number per text, all bounded by parameters.
Scoring covers every byte of every text.

Defined results: null and empty texts have difference 0; labels that are null
or of unknown documents don't count; several labels of a document count as
their mean, a half as good; several texts of a document are all learned from,
and give the curve their mean difference; documents with equal hashes are taken
by doc_id; if either class has no sample, the score is the
share of good labels, (good + 1) / (all + 2), for all texts; repeated rows get
equal scores; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import pick

PIECE = 4096
SAMPLE_ROWS = 4000
#: Pieces that a dictionary is trained on: 16 MB, some hundred times its size.
DICTIONARY_PIECES = 4096
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
#: Score from which a text is predicted to be good.
CUT = 0.3


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the curve; without dictionaries every score is ``sigmoid(offset)``."""

    good: bytes
    bad: bytes
    slope: float
    offset: float


class _Sizes:
    """Compressed sizes by one dictionary."""

    def __init__(self, content: bytes) -> None:
        import zstandard

        trained = zstandard.ZstdCompressionDict(content)
        trained.precompute_compress(level=LEVEL)
        self.pack = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=trained, write_content_size=False, write_dict_id=False, write_checksum=False
        ).compress

    def of(self, text: memoryview | bytes) -> int:
        return sum(len(self.pack(text[k : k + PIECE])) for k in range(0, len(text), PIECE))


def difference(text: memoryview | bytes, good: _Sizes, bad: _Sizes) -> float:
    """(b - g) / (b + g); 0 for an empty text."""
    if not len(text):
        return 0.0
    g, b = good.of(text), bad.of(text)
    return (b - g) / (b + g)


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; of too few pieces for training, their own bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _cut(batches):
    """The pieces of whole texts (good, doc_id, text), each with a hash of document and place."""
    for batch in batches:
        rows = []
        for good, doc_id, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            for k in range(0, len(text), PIECE):
                rows.append((good, md5(f"{doc_id}|{k}".encode()).digest(), text[k : k + PIECE]))
                if len(rows) == 1024:
                    yield _pieces(rows)
                    rows = []
        yield _pieces(rows)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["good", "at", "piece"])


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted, slightly damped logistic regression, by Newton steps."""
    scale = float(x.std()) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-3 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def held_out(doc_id: Column) -> Column:
    """Whether a document may not be learned from: crc32(doc_id as text) mod 5 is 0, or it has no doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, pieces: int = DICTIONARY_PIECES) -> Model:
    """The model of the labels (doc_id, quality) that aren't held out."""
    spark = docs.sparkSession
    known = (
        pick(labels, doc_id="doc_id", quality="quality")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("quality"))
        .filter("quality IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") >= 0.5).alias("good"))
    )
    counts = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    texts = pick(docs, doc_id="doc_id", text="text").filter("text IS NOT NULL AND doc_id IS NOT NULL")
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    there = known.join(texts.select("doc_id").distinct(), "doc_id").withColumn("at", F.md5(F.col("doc_id").cast("string").cast("binary")))
    few = [there.filter(F.col("good") == kind).orderBy("at", "doc_id").limit(sample_rows) for kind in (True, False)]
    chosen: dict[bool, list[int]] = {True: [], False: []}
    for row in sorted(few[0].unionByName(few[1]).collect(), key=lambda r: (r["at"], r["doc_id"])):  # at most twice sample_rows
        chosen[row["good"]].append(row["doc_id"])
    n_good, n_bad = counts.get(True, 0), counts.get(False, 0)
    share = (n_good + 1) / (n_good + n_bad + 2)
    if min(map(len, chosen.values())) < 4:
        return Model(b"", b"", 0.0, math.log(share / (1 - share)))
    roles = [(doc, kind, k < len(own) * 7 // 10) for kind, own in chosen.items() for k, doc in enumerate(own)]
    sample = F.broadcast(spark.createDataFrame(roles, "doc_id long, good boolean, learn boolean"))
    own = texts.join(sample, "doc_id")
    learned = own.filter("learn").select("good", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_cut, "good boolean, at binary, piece binary")
    trained = {}
    for kind in (True, False):
        least = learned.filter(F.col("good") == kind).orderBy("at", "piece").limit(pieces).collect()
        trained[kind] = _dictionary([bytes(r["piece"]) for r in least])
    model = Model(trained[True], trained[False], 0.0, 0.0)
    rest = own.filter("NOT learn").select("doc_id", "text")
    measured = score(rest, model).groupBy("doc_id").agg(F.avg("difference").alias("x")).join(sample, "doc_id").select("doc_id", "good", "x")
    x, y, weight = [], [], []
    found = sorted(measured.collect(), key=lambda r: r["doc_id"])
    for kind, n in ((True, n_good), (False, n_bad)):
        values = [r["x"] for r in found if r["good"] == kind]
        x += values
        y += [float(kind)] * len(values)
        weight += [n / (n_good + n_bad) / len(values) * 1000] * len(values)
    slope, offset = _curve(np.array(x), np.array(y), np.array(weight))
    return Model(model.good, model.bad, slope, offset)


def _scorer(model):
    def score(batches):
        own = Model(**model.value)
        good, bad = (_Sizes(own.good), _Sizes(own.bad)) if own.good else (None, None)
        for batch in batches:
            text = batch.column("text")
            raw = [] if good is None else text.cast(pa.binary()).to_pylist()
            x = np.zeros(batch.num_rows) if good is None else np.array([difference(t or b"", good, bad) for t in raw])
            p = 1 / (1 + np.exp(-np.clip(own.slope * x + own.offset, -700, 700)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(x), pa.array(p)], names=["doc_id", "difference", "score"])

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, difference and score (0 to 1, high: good) of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(spark.sparkContext.broadcast(vars(model))), "doc_id long, difference double, score double")


def _filter(model, keep_from: float):
    def keep(batches):
        own = Model(**model.value)
        if not own.good:
            ok = 1 / (1 + math.exp(-own.offset)) >= keep_from
            yield from (b for b in batches if ok)
            return
        good, bad = _Sizes(own.good), _Sizes(own.bad)
        least = (math.log(keep_from / (1 - keep_from)) - own.offset) / own.slope if own.slope else -math.inf
        for batch in batches:
            x = np.array([difference(t or b"", good, bad) for t in batch.column("__text").cast(pa.binary()).to_pylist()])
            ok = x >= least if own.slope >= 0 else x <= least
            yield batch.drop_columns(["__text"]).filter(pa.array(ok))

    return keep


def keep_good(docs: DataFrame, model: Model, keep_from: float = CUT) -> DataFrame:
    """Rows of ``docs`` whose score is at least ``keep_from``, in one pass without a join."""
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = f"_c{names.index('text')}"
    rows = plain.withColumn("__text", F.coalesce(F.col(at).cast("string"), F.lit("")))
    kept = rows.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(vars(model)), keep_from), plain.schema)
    return kept.toDF(*names)
