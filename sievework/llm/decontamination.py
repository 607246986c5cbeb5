"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the postings of all training words, in segments of
about ``segment_bytes`` of text: per segment a sorted dictionary of word hashes
and, for each, the positions of all its occurrences. A segment is made and
searched by one task, so postings are never shuffled and a word that is in
every document costs no task more than its own segment.

``search`` keys each window of the benchmark by that of its words which is in
the fewest windows. A segment looks up its own words, and so meets only windows
whose rarest test word it has: its work grows with the words that it shares with
the benchmark, not with the benchmark. A window with another word that the
segment lacks is out; for the others the position lists are intersected after
subtracting each word's offset in the window, from the segment's rarest word on.
What is left are exact phrase matches. With ``slop`` the words may also stand in
any order within ``window + slop`` words (proximity match).

The benchmark is searched in blocks of ``block_bytes`` of text, each of which is
made into plain arrays of about 30 times that on the driver, sent to the
executors, and released once its matches are stored; each block reads the index
once. An item longer than a block is cut into pieces that overlap by a window.

Words are compared by 64-bit hashes. A wrong phrase match needs a collision of
every differing word at its very position.

Defined results: a null or wordless text has ``n_words`` 0 and no matches; a
null ``doc_id`` is kept as null; repeated rows each get a row; items with a
null text or no words match nothing; items with equal texts all match; different
texts of one ``item_id`` are one item; words that an item of null id matches are
hit, but the item isn't listed; empty tables give empty results; further columns
are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import few_files, flat, pick, shared_path, stored, text_batches
from sievework.llm.words import ALPHANUMERIC, words_of

WINDOW = 10
SEGMENT_BYTES = 1 << 20
#: Benchmark text in one block of queries; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 4 << 20

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("segment", T.StringType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("n_words", T.ArrayType(T.LongType())),
        T.StructField("terms", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("positions", T.BinaryType()),
    ]
)
_INDEX_ARROW = pa.schema(
    [
        ("segment", pa.string()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int64())),
        ("terms", pa.binary()),
        ("counts", pa.binary()),
        ("positions", pa.binary()),
    ]
)
MATCH_SCHEMA = (
    "segment string, ordinal int, doc_id long, n_words long, "
    "spans array<struct<item_id:long,start:long,end:long>>"
)
_MATCH_ARROW = pa.schema(
    [
        ("segment", pa.string()),
        ("ordinal", pa.int32()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text), as stored in the shared folder."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        packer = zstandard.ZstdCompressor(level=1)
        task = TaskContext.get()
        where = f"{task.partitionId() if task else 0}"
        for number, table in enumerate(text_batches(batches, "text", segment_bytes)):
            words = words_of(flat(table["text"]), ALPHANUMERIC)
            order = np.argsort(words.hashes, kind="stable")
            ranked = words.hashes[order]
            new = np.ones(len(ranked), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            begin = np.flatnonzero(new)
            yield pa.record_batch(
                [
                    pa.array([f"{where}-{number}"]),
                    pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64())),
                    pa.array([words.counts.tolist()], pa.list_(pa.int64())),
                    pa.array([ranked[begin].tobytes()], pa.binary()),
                    pa.array([np.diff(np.append(begin, len(ranked))).astype(np.uint32).tobytes()], pa.binary()),
                    pa.array([packer.compress(order.astype(np.uint32).tobytes())], pa.binary()),
                ],
                schema=_INDEX_ARROW,
            )

    rows = pick(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    path = shared_path(docs.sparkSession, "postings")
    few_files(rows.mapInArrow(segments, INDEX_SCHEMA)).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


class Queries:
    """Distinct windows of some benchmark items, with the items each stands for; all in plain arrays."""

    @classmethod
    def of(cls, state: dict) -> Queries:
        """From ``vars`` of another; plain values, which any executor can read."""
        out = cls([], 1)
        vars(out).update(state)
        return out

    def __init__(self, items: list[tuple[int | None, str]], window: int) -> None:
        words = words_of(pa.array([text or "" for _, text in items], pa.string()), ALPHANUMERIC)
        self.vocabulary, word = np.unique(words.hashes, return_inverse=True)
        counts = words.counts
        windows = np.where(counts >= window, counts - window + 1, (counts > 0).astype(np.int64))
        item = np.repeat(np.arange(len(items)), windows)
        size = np.minimum(counts, window)[item]
        start = words.offsets[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        #: Numbers in the vocabulary; short windows are filled with the last place, an always present word.
        every = np.full((len(item), window), len(self.vocabulary), np.int32)
        for j in range(window):
            long = np.flatnonzero(size > j)
            every[long, j] = word[start[long] + j]
        _, first, which = np.unique(every.view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
        self.words, self.size = every[first], size[first].astype(np.int64)
        order = np.argsort(which, kind="stable")
        self.item_offsets = np.searchsorted(which[order], np.arange(len(first) + 1))
        self.item_ids = [items[k][0] for k in item[order].tolist()]
        # each window by the word of it that is in the fewest windows
        frequency = np.append(np.bincount(self.words.ravel(), minlength=len(self.vocabulary) + 1)[:-1], np.iinfo(np.int64).max)
        key = self.words[np.arange(len(first)), np.argmin(frequency[self.words], axis=1)] if len(first) else np.zeros(0, np.int32)
        self.by_key = np.argsort(key, kind="stable")
        self.key_offsets = np.searchsorted(key[self.by_key], np.arange(len(self.vocabulary) + 1))

    def items(self, window: int) -> set[int | None]:
        """The items that a window stands for."""
        return set(self.item_ids[self.item_offsets[window] : self.item_offsets[window + 1]])

    def candidates(self, there: np.ndarray) -> np.ndarray:
        """Windows all of whose words are ``there`` (by vocabulary), looked up by their rarest words."""
        found = np.flatnonzero(there)
        begin, counts = self.key_offsets[found], self.key_offsets[found + 1] - self.key_offsets[found]
        at = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        windows = self.by_key[at]
        return windows[np.append(there, True)[self.words[windows]].all(axis=1)]


def _phrase(lists: list[np.ndarray]) -> np.ndarray:
    """Starts of the phrase whose word ``j`` is at the positions ``lists[j]``."""
    order = sorted(range(len(lists)), key=lambda j: len(lists[j]))
    starts = lists[order[0]].astype(np.int64) - order[0]
    for j in order[1:]:
        if not len(starts):
            break
        wanted = starts + j
        at = np.searchsorted(lists[j], wanted)
        at[at == len(lists[j])] = 0
        starts = starts[lists[j][at] == wanted]
    return starts


def _near(lists: list[np.ndarray], names: list[int], width: int) -> np.ndarray:
    """Starts of runs of ``width`` words that hold all words, as often as the phrase does."""
    need = {name: names.count(name) for name in names}
    by_name = {name: lists[names.index(name)].astype(np.int64) for name in need}
    rarest = min(by_name, key=lambda name: len(by_name[name]))
    starts = np.unique((by_name[rarest][:, None] - np.arange(width)[None, :]).ravel())
    used = np.unique(np.concatenate(list(by_name.values())))
    starts = np.intersect1d(starts, used, assume_unique=True)  # a run begins with one of the words
    for name, times in need.items():
        own = by_name[name]
        at = np.searchsorted(own, starts) + times - 1
        ok = at < len(own)
        ok[ok] = own[at[ok]] < starts[ok] + width
        starts = starts[ok]
    return starts


def _merged(spans: list[tuple[int, int, int]]) -> list[dict]:
    """Spans of one item that touch or overlap become one."""
    out: list[list[int]] = []
    for item, start, end in sorted(spans, key=lambda s: (s[0] is None, s[0] or 0, s[1], s[2])):
        if out and out[-1][0] == item and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([item, start, end])
    return [{"item_id": a, "start": b, "end": c} for a, b, c in out]


def _searcher(queries, slop: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        asked = Queries.of(queries.value)
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda name: batch.column(name)[row]  # noqa: E731, B023
                n_words = np.array(value("n_words").as_py(), np.int64)
                offsets = np.concatenate([[0], np.cumsum(n_words)])
                terms = np.frombuffer(value("terms").as_py(), np.uint64)
                counts = np.frombuffer(value("counts").as_py(), np.uint32)
                hits: dict[int, list] = {}
                if len(terms) and len(asked.vocabulary):
                    _, shared, place = np.intersect1d(asked.vocabulary, terms, assume_unique=True, return_indices=True)
                    there = np.zeros(len(asked.vocabulary), bool)
                    there[shared] = True
                    alive = asked.candidates(there)
                    if len(alive):
                        places = dict(zip(shared.tolist(), place.tolist(), strict=True))
                        positions = np.frombuffer(unpacker.decompress(value("positions").as_py()), np.uint32)
                        begin = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                        for q in alive:
                            size = int(asked.size[q])
                            names = asked.words[q, :size].tolist()
                            lists = [positions[begin[places[v]] : begin[places[v] + 1]] for v in names]
                            width = size + slop
                            starts = _near(lists, names, width) if slop else _phrase(lists)
                            if not len(starts):
                                continue
                            starts = starts[starts >= 0]
                            docs = np.searchsorted(offsets, starts, "right") - 1
                            if slop:  # a run may end with its document
                                ends = np.minimum(starts + width, offsets[docs + 1])
                                inside = np.ones(len(starts), bool)
                                for name in set(names):
                                    own = lists[names.index(name)]
                                    at = np.searchsorted(own, starts) + names.count(name) - 1
                                    inside &= (at < len(own)) & (own[np.minimum(at, len(own) - 1)] < ends)
                            else:
                                ends = starts + size
                                inside = ends <= offsets[docs + 1]
                            for d, s, e in zip(docs[inside].tolist(), starts[inside].tolist(), ends[inside].tolist(), strict=True):
                                own = hits.setdefault(d, [])
                                own.extend((item, s - int(offsets[d]), e - int(offsets[d])) for item in asked.items(q))
                n = len(n_words)
                yield pa.record_batch(
                    [
                        pa.array([value("segment").as_py()] * n, pa.string()),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(value("doc_ids").as_py(), pa.int64()),
                        pa.array(n_words),
                        pa.array([_merged(hits.get(d, [])) for d in range(n)], _MATCH_ARROW.field("spans").type),
                    ],
                    schema=_MATCH_ARROW,
                )

    return run


def _pieces(text: str, limit: int, window: int) -> Iterator[str]:
    """``text``, or parts of at most about ``limit`` bytes that overlap by a window less one word."""
    if len(text) <= limit:
        yield text
        return
    words = words_of(pa.array([text], pa.large_string()), ALPHANUMERIC)
    at, n = 0, len(words.starts)
    while at < n:
        end = int(np.searchsorted(words.ends, words.starts[at] + limit, "right"))
        end = min(n, max(end, at + window))
        yield words.data[words.starts[at] : words.ends[end - 1]].tobytes().decode()
        at = n if end == n else end - window + 1


def _blocks(benchmark: DataFrame, limit: int, window: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of at most about ``limit`` characters; one block is in memory at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    rows = pick(benchmark, item_id="item_id", text="text").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for item_id, text in rows.dropna(subset=["text"]).toLocalIterator():
        for piece in _pieces(text, limit, window):
            if held and size + len(piece) > limit:
                yield held
                held, size = [], 0
            held.append((item_id, piece))
            size += len(piece)
    yield held


def search(
    index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Matches of the benchmark (item_id, text) in an index.

    Returns per training row: segment, ordinal (its place there), doc_id,
    n_words and spans, an array of (item_id, start, end) in words; an item's
    overlapping windows are one span within a block.
    """
    context = index.sparkSession.sparkContext
    blocks = _blocks(benchmark, block_bytes, window)
    block, following = next(blocks), next(blocks, None)
    sent = context.broadcast(vars(Queries(block, window)))
    if following is None:
        return index.mapInArrow(_searcher(sent, slop), MATCH_SCHEMA)
    hits: list[DataFrame] = []
    while sent is not None:
        found = index.mapInArrow(_searcher(sent, slop), MATCH_SCHEMA).filter(F.size("spans") > 0).select("segment", "ordinal", "spans")
        hits.append(stored(found, "matches"))
        sent.destroy()
        sent = None if following is None else context.broadcast(vars(Queries(following, window)))
        following = next(blocks, None)
    union = functools.reduce(DataFrame.unionByName, hits).groupBy("segment", "ordinal").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("ordinal", "row"))
    rows = rows.select("segment", "ordinal", F.col("row.doc_ids").alias("doc_id"), F.col("row.n_words").alias("n_words"))
    none = F.array().cast("array<struct<item_id:long,start:long,end:long>>")
    return rows.join(union, ["segment", "ordinal"], "left").withColumn("spans", F.coalesce("spans", none))


def summarise(matches: DataFrame) -> DataFrame:
    """Per row of ``search``: n_hit (words inside spans) and the sorted item ids."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"])))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach"))
    hit = F.aggregate(
        ordered,
        zero,
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(s["end"] - F.greatest(a["reach"], s["start"]), F.lit(0))).alias("hit"),
            F.greatest(a["reach"], s["end"]).alias("reach"),
        ),
        lambda a: a["hit"],
    )
    items = F.array_sort(F.array_compact(F.array_distinct(F.transform("spans", lambda s: s["item_id"].cast("string")))))
    return matches.select("segment", "ordinal", "doc_id", "n_words", hit.alias("n_hit"), items.alias("items"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """``search`` and ``summarise`` over a new index of ``docs``."""
    return summarise(search(build_index(docs), benchmark, window, slop))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` without a match, with the columns of ``docs``.

    Rows are told apart by a hash of doc_id and text, so that a row with a null
    ``doc_id`` goes or stays for its own text.
    """
    rows = pick(docs, doc_id="doc_id", text="text")
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hit = decontaminate(rows.select(row.alias("doc_id"), "text"), benchmark, window).filter("n_hit > 0")
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    own = F.xxhash64(F.col(f"_c{names.index('doc_id')}").cast("long"), F.col(f"_c{names.index('text')}").cast("string"))
    left = plain.withColumn("__row", own).join(hit.select(F.col("doc_id").alias("__row")).distinct(), "__row", "left_anti")
    return few_files(left.drop("__row")).toDF(*names)
