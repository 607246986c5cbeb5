"""Substring dedup: a De Bruijn graph of token k-mers, compacted to repeated paths.

Every window of ``k`` words is an edge from its first to its last k-1 words.

1. Documents are dealt into parts of about ``part_bytes`` of text by a hash.
   A part sends each distinct edge once, with the coordinates (document and
   word) at which it first starts, in packed rows: one for each range of edge
   hashes that it has edges of. An edge that is in every document therefore
   meets at most once per part.
2. Edges are joined by hash (one task per range): each part that has an edge
   whose first document lies elsewhere is told the coordinates there.
3. A second join by part brings these answers to the texts. Each document is a
   walk in the graph, so an edge's neighbours need no search: consecutive
   repeated edges whose sources are consecutive words of one document form a
   nonbranching path, and are compacted into a span.
4. A third join takes each distinct span of a part to the part of its source,
   where its words are compared with those at the source's coordinates (by a
   128-bit digest of both runs of words). Spans that are equal go back by a
   fourth join, and the words that they cover go. A passage that every document
   has is asked for at most once per part.

The texts are shuffled once, compressed one by one: all joins by part read the
same exchange. Edges are
64-bit hashes; with N windows about N**2 / 2**65 pairs collide. Such a pair
never removes a word: its span fails the comparison. (It may hide a true source
of that one edge.)

Defined results: a null or wordless text loses nothing; a row with a null
``doc_id`` is never a source and loses nothing; rows with one ``doc_id`` are
one document; texts of fewer than ``k`` words lose nothing; empty tables give
empty results; further columns are ignored.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import few_files, flat
from sievework.llm.words import BLANK_SEPARATED, U64, Words, window_hashes, words_of

K = 13
PART_BYTES = 2 << 20
#: Edges that one task joins at once, about.
RANGE_EDGES = 750_000

SPAN = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.LongType()) for n in ("start", "end", "source_doc", "source_start")]
    )
)
_SPAN_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "source_doc", "source_start")]))


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed."""
    import zstandard

    raw = values.astype(np.int64, copy=False).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(raw.T.tobytes())


def _numbers(data: bytes) -> np.ndarray:
    """The inverse of ``_planes``."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()


def _packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences."""
    change = values.astype(np.int64, copy=True).view(U64)
    change[1:] -= values.astype(np.int64, copy=False).view(U64)[:-1]
    return _planes(change.view(np.int64))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data).view(U64), dtype=U64)


def _packed_texts(schema: pa.Schema):
    """Batches with ``__text`` compressed."""

    def pack(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        at = schema.get_field_index("__text")
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            packed = pa.array([None if t is None else packer.compress(t) for t in texts.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if i == at else c for i, c in enumerate(batch.columns)], schema=schema)

    return pack


def _unpacked_texts(packed: pa.Array) -> pa.Array:
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    return pa.array([None if t is None else unpacker.decompress(t) for t in packed.to_pylist()], pa.binary()).cast(pa.string())


class _Texts:
    """The texts of a part, by document, and their words."""

    def __init__(self, table: pa.Table) -> None:
        doc = flat(table["__doc"])
        order = pc.array_sort_indices(doc)  # nulls last
        self.table = table.take(order)
        doc = doc.take(order)
        self.n_ids = len(doc) - doc.null_count
        self.doc = doc.fill_null(0).to_numpy(zero_copy_only=False)
        self.row = flat(self.table["__row"]).to_numpy()
        self.text = _unpacked_texts(flat(self.table["__text"]))
        self.words: Words = words_of(self.text, BLANK_SEPARATED)

    def rows_of(self, doc: int) -> range:
        own = self.doc[: self.n_ids]
        return range(int(np.searchsorted(own, doc)), int(np.searchsorted(own, doc, "right")))

    def digest(self, first: int, end: int) -> bytes:
        """A digest of a run of words, whatever blanks are between them."""
        raw = self.words.data[self.words.starts[first] : self.words.ends[end - 1]].tobytes()
        return blake2b(b" ".join(raw.split()), digest_size=16).digest()


class _Part(_Texts):
    """The edges of a part: all windows, and the distinct ones by hash with their first coordinates."""

    def __init__(self, table: pa.Table, k: int, ranges: int) -> None:
        super().__init__(table)
        at, hashes = window_hashes(self.words, k)
        row = np.searchsorted(self.words.offsets, at, "right") - 1
        use = row < self.n_ids
        self.at, hashes, self.window_row = at[use], hashes[use], row[use]
        self.window_doc = self.doc[self.window_row]
        order = np.argsort(hashes, kind="stable")  # documents ascend, so the first of equal edges is the source
        ranked = hashes[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.edges = ranked[new]
        first = order[new]
        self.first_doc = self.window_doc[first]
        self.first_start = self.at[first] - self.words.offsets[self.window_row[first]]
        self.edge_of = np.empty(len(order), np.int64)
        self.edge_of[order] = np.cumsum(new) - 1
        edge_range = ((self.edges >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
        head = np.ones(len(edge_range), bool)
        head[1:] = edge_range[1:] != edge_range[:-1]
        begin = np.flatnonzero(head)
        #: (range, first edge, edge after) of each range that has edges.
        self.cuts = list(zip(edge_range[begin].tolist(), begin.tolist(), np.append(begin[1:], len(edge_range)).tolist(), strict=True)) if len(begin) else []


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_EDGES = "range long, part long, edges binary, docs binary, starts binary"
_ANSWERS = "__part long, range long, ranks binary, docs binary, parts binary, starts binary"
#: A distinct span of a part, and the places (document, text's hash, first word) where it stands there.
_SPANS = "part long, source_part long, source_doc long, source_start long, length long, digest binary, places binary"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


def _send(k: int, ranges: int):
    schema = _arrow(_EDGES)

    def send(table: pa.Table) -> pa.Table:
        part = _Part(table, k, ranges)
        own = table["__part"][0].as_py()
        rows = [
            (r, own, _packed(part.edges[a:b].view(np.int64)), _planes(part.first_doc[a:b]), _planes(part.first_start[a:b])) for r, a, b in part.cuts
        ]
        return _table(rows, schema)

    return send


def _answer(table: pa.Table) -> pa.Table:
    """For each part the edges of this range that start in an earlier document of another part, and where."""
    parts = table["part"].to_pylist()
    edges = [_unpacked(x.as_py()) for x in table["edges"]]
    sizes = [len(x) for x in edges]
    every = np.concatenate(edges)
    doc, start = (np.concatenate([_numbers(x.as_py()) for x in table[n]]) for n in ("docs", "starts"))
    part = np.repeat(np.array(parts, np.int64), sizes)
    del edges
    order = np.argsort(every, kind="stable")
    ranked, ranked_doc = every[order], doc[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    least = np.flatnonzero(ranked_doc == np.minimum.reduceat(ranked_doc, begin)[run])
    chosen = least[np.searchsorted(run[least], np.arange(len(begin)))]  # the first with the least document
    source = np.empty(len(order), np.int64)
    source[order] = order[chosen][run]
    told, at = [], 0
    for own, n in zip(parts, sizes, strict=True):
        origin = source[at : at + n]
        ranks = np.flatnonzero(doc[origin] < doc[at : at + n])
        at += n
        if len(ranks):
            origin = origin[ranks]
            told.append((own, table["range"][0].as_py(), _packed(ranks), _planes(doc[origin]), _planes(part[origin]), _planes(start[origin])))
    return _table(told, _arrow(_ANSWERS))


def _paths(k: int, ranges: int):
    schema = _arrow(_SPANS)

    def paths(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """The compacted repeated paths of a part's documents, with the coordinates of their sources."""
        if not texts.num_rows:
            return schema.empty_table()
        part = _Part(texts, k, ranges)
        own = texts["__part"][0].as_py()
        doc, start, where = part.first_doc.copy(), part.first_start.copy(), np.full(len(part.edges), own)
        first = {r: a for r, a, _ in part.cuts}
        for r, ranks, *told in zip(answers["range"].to_pylist(), *[answers[n] for n in ("ranks", "docs", "parts", "starts")], strict=True):
            at = first[r] + _unpacked(ranks.as_py()).view(np.int64)
            doc[at], where[at], start[at] = (_numbers(x.as_py()) for x in told)
        origin = doc[part.edge_of]
        again = origin < part.window_doc
        at, row, edge = part.at[again], part.window_row[again], part.edge_of[again]
        origin, where, start = origin[again], where[edge], start[edge]
        head = np.ones(len(at), bool)
        head[1:] = (
            (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (origin[1:] != origin[:-1]) | (where[1:] != where[:-1]) | (start[1:] != start[:-1] + 1)
        )
        heads = np.flatnonzero(head)
        ends = at[np.append(heads[1:], len(at)) - 1] + k if len(heads) else heads
        base = part.words.offsets[row[heads]]
        places = np.stack([part.doc[row[heads]], part.row[row[heads]], at[heads] - base], axis=1)
        spans: dict[tuple, list[int]] = {}
        for n, key in enumerate(zip(where[heads].tolist(), origin[heads].tolist(), start[heads].tolist(), at[heads].tolist(), ends.tolist(), strict=True)):
            spans.setdefault((*key[:3], key[4] - key[3], part.digest(*key[3:])), []).append(n)
        return _table([(own, *key, places[found].tobytes()) for key, found in spans.items()], schema)

    return paths


def _verify(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """The spans whose words stand at their source's coordinates."""
    schema = _arrow(_SPANS)
    if not texts.num_rows or not spans.num_rows:
        return schema.empty_table()
    part = _Texts(texts)
    known: dict[tuple[int, int, int], set[bytes]] = {}
    good = []
    for doc, start, length, digest in zip(*[spans[n].to_pylist() for n in ("source_doc", "source_start", "length", "digest")], strict=True):
        place = doc, start, length
        if place not in known:
            rows = [part.words.offsets[r : r + 2].tolist() for r in part.rows_of(doc)]
            known[place] = {part.digest(low + start, low + start + length) for low, high in rows if low + start + length <= high}
        good.append(digest in known[place])
    return spans.filter(pa.array(good))


def _without(words: Words, byte_offsets: np.ndarray, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts without the removed words and the gaps after them, and the new offsets."""
    n = len(words.data)
    change = np.zeros(n + 1, np.int32)
    rows = words.text_of_words()
    stops = np.append(words.starts[1:], n)
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    stops = np.where(last, byte_offsets[rows + 1], stops)
    np.add.at(change, words.starts[removed], 1)
    np.add.at(change, stops[removed], -1)
    keep = np.cumsum(change[:-1]) == 0
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return words.data[keep], kept_before[byte_offsets]


def _strip(schema: pa.Schema):
    def strip(texts: pa.Table, spans: pa.Table) -> pa.Table:
        """The texts without the words in their spans."""
        if not texts.num_rows:
            return schema.empty_table()
        part = _Texts(texts)
        words, table = part.words, part.table
        change = np.zeros(len(words.hashes) + 1, np.int32)
        found: list[list[dict]] = [[] for _ in range(table.num_rows)]
        standing: set[tuple[int, ...]] = set()
        for length, *source, places in zip(*[spans[n].to_pylist() for n in ("length", "source_doc", "source_start", "places")], strict=True):
            for doc, text, start in np.frombuffer(places, np.int64).reshape(-1, 3).tolist():
                standing.add((doc, text, start, start + length, *source))
        for doc, text, start, end, source_doc, source_start in sorted(standing):
            for row in part.rows_of(doc):
                if part.row[row] == text:
                    base = words.offsets[row]
                    change[base + start] += 1
                    change[base + end] -= 1
                    found[row].append({"start": start, "end": end, "source_doc": source_doc, "source_start": source_start})
        removed = np.cumsum(change[:-1]) > 0
        text = out = part.text
        if removed.any():
            lengths = np.asarray(pc.binary_length(text.fill_null("")), dtype=np.int64)
            data, offsets = _without(words, np.concatenate([[0], np.cumsum(lengths)]), np.flatnonzero(removed))
            valid = np.asarray(text.is_valid())
            out = pa.StringArray.from_buffers(
                len(text),
                pa.py_buffer(offsets.astype(np.int32).tobytes()),
                pa.py_buffer(data.tobytes()),
                pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()),
            )
        counts = np.concatenate([[0], np.cumsum(removed)])[words.offsets]
        new = {
            "text": out,
            "n_words": pa.array(words.counts.astype(np.int64)),
            "n_removed": pa.array(np.diff(counts).astype(np.int64)),
            "spans": pa.array(found, _SPAN_ARROW),
        }
        columns = [new[f.name] if f.name in new else table[f.name] for f in schema]
        return pa.table([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    return strip


def dedup_substrings(docs: DataFrame, k: int = K, part_bytes: int = PART_BYTES, carry: bool = False) -> DataFrame:
    """``docs`` without the words that earlier documents have in windows of ``k`` words.

    Returns doc_id (long), text (what is left, with its own white space),
    n_words, n_removed and spans; with ``carry`` the columns of ``docs``, the
    text replaced, and after them n_words, n_removed and spans.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = docs.columns
    at = {n: f"_c{i}" for i, n in reversed(list(enumerate(names)))}
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    base = plain.select(
        *([c for c in plain.columns if c != at["text"]] if carry else []),
        F.col(at["doc_id"]).cast("long").alias("__doc"),
        F.col(at["text"]).cast("string").alias("__text"),
    )
    total = base.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    ranges = max(1, math.ceil(total / 6 / RANGE_EDGES))
    base = base.withColumn("__row", F.xxhash64("__text"))
    base = base.withColumn("__part", F.pmod(F.xxhash64("__doc", "__row"), F.lit(parts)).cast("long"))
    packed = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "__text" else f.dataType) for f in base.schema])
    base = base.mapInArrow(_packed_texts(to_arrow_schema(packed)), packed)
    out = T.StructType(
        [
            *[f for f in base.schema if f.name.startswith("_c") or f.name == "__doc"],
            T.StructField("text", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", SPAN),
        ]
    )
    by_part = base.groupBy("__part")
    edges = by_part.applyInArrow(_send(k, ranges), _EDGES)
    answers = edges.groupBy("range").applyInArrow(_answer, _ANSWERS)
    spans = by_part.cogroup(answers.groupBy("__part")).applyInArrow(_paths(k, ranges), _SPANS)
    verified = by_part.cogroup(spans.groupBy("source_part")).applyInArrow(_verify, _SPANS)
    done = by_part.cogroup(verified.groupBy("part")).applyInArrow(_strip(to_arrow_schema(out)), out)
    done = few_files(done)
    found = [F.col(n) for n in ("n_words", "n_removed", "spans")]
    if not carry:
        return done.select(F.col("__doc").alias("doc_id"), "text", *found)
    own = [F.col("text" if f"_c{i}" == at["text"] else f"_c{i}").alias(n) for i, n in enumerate(names)]
    return done.select(*own, *found)
