"""N-gram Jaccard self-join by chosen paths.

Every text is the set of its shingles of ``size`` words (a shorter text: one
shingle of all its words). Texts of equal words are one node with its number
of copies. Nodes are embedded as ``COORDINATES`` MinHash values, tokens that
two sets share with a probability equal to their Jaccard similarity.

Chosen paths: in each run and at each level a node chooses, by a hash of its
path, one of ``CHOICES`` tokens and goes on along the path extended by it. Each
run and level has its own MinHash values, so runs are independent: two sets at
the threshold share a path of ``DEPTH`` tokens in a run with probability
``threshold ** DEPTH``. Buckets of at most ``SMALL_BUCKET`` nodes are compared
by brute force on the ``COORDINATES`` values, larger ones are split by the next
level with all their nodes, and what is still large at ``DEPTH`` tokens is
compared in full, as pairs of blocks. So no pair can be lost later than there,
and ``runs_for`` holds for buckets of every size; it also counts the pairs whose
estimate from the ``COORDINATES`` values falls short.

What was found joins nodes to candidate clusters. Within a cluster, exact
Jaccard similarities of all nodes are counted from their whole shingle sets, a
cluster of more than ``BLOCK`` nodes as pairs of blocks; only counts and one
link per node and block pair leave a task, never all pairs.

Defined results: a null or wordless text is alone in its class, with no links;
a row with a null ``doc_id`` has a null class and no links; rows with one
``doc_id`` and one text count as copies of each other; empty tables give empty
results; further columns are ignored. Ties don't arise: a class is named by its
least ``doc_id``.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import few_files, flat, pick, stored, text_batches
from sievework.llm.components import components
from sievework.llm.words import BLANK_SEPARATED, U64, Words, mix, span_hashes, words_of

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.999
COORDINATES = 64
#: Tokens of the longest path. Buckets that are large at the last are compared in full.
DEPTH = 3
#: Tokens of a run and level of which a path chooses one.
CHOICES = 2
SMALL_BUCKET = 64
BLOCK = 512
#: Candidates may fall short of the threshold by so many standard deviations of the MinHash estimate.
DEVIATIONS = 4.5
_SEED = 0x51ED270B


def least_equal(threshold: float) -> int:
    """Equal values of ``COORDINATES`` from which on two nodes are linked."""
    return math.ceil((threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / COORDINATES)) * COORDINATES)


def runs_for(recall: float, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs after which two sets at the threshold share a path of ``depth`` tokens and pass the estimate with probability ``recall``."""
    short = sum(math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in range(least_equal(threshold)))
    if short >= 1 - recall:
        raise ValueError(f"a recall of {recall} needs more than {COORDINATES} values")
    return max(1, math.ceil(math.log(1 - recall - short) / math.log(1 - threshold**depth))) if threshold < 1 else 1


def _choice(path: np.ndarray) -> np.ndarray:
    """Which of the next level's tokens each path goes on with."""
    return (mix(path ^ U64(_SEED)) % U64(CHOICES)).astype(np.int64)


def _extended(path: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(path + coordinate.astype(U64)) ^ token.astype(U64))


def shingle_spans(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of each shingle, and the number of shingles of each text."""
    counts = words.counts
    shingles = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    ends = np.cumsum(shingles)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - shingles, shingles)
    starts = np.repeat(words.offsets[:-1], shingles) + within
    return starts, np.repeat(np.minimum(counts, size), shingles), shingles


def _node_ids(words: Words) -> np.ndarray:
    """Two 64-bit hashes of each text's whole word sequence."""
    counts = words.counts
    some = counts > 0
    first = np.zeros(len(counts), U64)
    first[some] = span_hashes(words, words.offsets[:-1][some], counts[some])
    twisted = Words(words.data, words.starts, words.ends, mix(words.hashes ^ U64(_SEED)), words.offsets)
    second = np.zeros(len(counts), U64)
    second[some] = span_hashes(twisted, words.offsets[:-1][some], counts[some])
    return np.stack([first, second], axis=1)


def _signed(size: int, runs: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("node", pa.binary()),
            ("shingles", pa.int64()),
            ("tokens", pa.binary()),
            ("steps", pa.binary()),
            ("paths", pa.list_(pa.int64())),
        ]
    )
    # the estimate's values, then those of each run, level and choice
    values = COORDINATES + runs * DEPTH * CHOICES
    run = mix(np.arange(runs, dtype=U64))
    first = _choice(run)
    coordinate = COORDINATES + np.arange(runs) * DEPTH * CHOICES + first
    factors = (mix(np.arange(values, dtype=U64) + U64(_SEED)) >> U64(32)).astype(np.uint32) | np.uint32(1)

    def sign(batches):
        for table in text_batches(batches, "text", 1 << 20):
            words = words_of(flat(table["text"]), BLANK_SEPARATED)
            starts, sizes, counts = shingle_spans(words, size)
            some = np.flatnonzero(counts)
            tokens = np.zeros((len(counts), values), np.uint32)
            if len(some):
                low = (span_hashes(words, starts, sizes) >> U64(32)).astype(np.uint32)
                begin = (np.cumsum(counts) - counts)[some]
                for j, factor in enumerate(factors):
                    value = low * factor
                    value ^= value >> np.uint32(15)
                    value *= np.uint32(0x2C1B3C6D)
                    tokens[some, j] = np.minimum.reduceat(value, begin)
            ids = _node_ids(words)
            paths = _extended(run[None, :], first[None, :], tokens[:, coordinate]).view(np.int64)
            offsets = np.arange(0, paths.size + 1, runs, dtype=np.int32)
            raw = tokens.astype(np.uint16)
            yield pa.record_batch(
                [
                    flat(table["doc_id"]),
                    pa.array([x.tobytes() if n else None for x, n in zip(ids, counts, strict=True)], pa.binary()),
                    pa.array(counts.astype(np.int64)),
                    pa.array([x[:COORDINATES].tobytes() for x in raw], pa.binary()),
                    pa.array([x[COORDINATES:].tobytes() for x in raw], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(paths.ravel())),
                ],
                schema=schema,
            )

    return sign


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def _roots(labels: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component, given links a-b."""
    root = np.arange(labels)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _group_roots(key: np.ndarray, tokens: np.ndarray, need: int) -> np.ndarray:
    """Rows are sorted by key; within each key, components of rows with ``need`` equal tokens."""
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(edges, len(key)))
    found_a, found_b = [], []
    for begin, n in zip(edges[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        own = np.ascontiguousarray(tokens[begin : begin + n].T)
        for k in range(0, n, 256):
            equal = np.zeros((min(256, n - k), n), np.uint8)
            for values in own:
                equal += values[k : k + 256, None] == values[None, :]
            x, y = np.nonzero(equal >= need)
            found_a.append(begin + k + x)
            found_b.append(begin + y)
    for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL_BUCKET)]):
        i, j = np.triu_indices(n, 1)
        begin = edges[sizes == n]
        step = max(1, 100_000 // len(i))
        for k in range(0, len(begin), step):
            a = (begin[k : k + step, None] + i[None, :]).ravel()
            b = (begin[k : k + step, None] + j[None, :]).ravel()
            for c in range(0, len(a), 100_000):
                x, y = a[c : c + 100_000], b[c : c + 100_000]
                ok = (tokens[x] == tokens[y]).sum(axis=1) >= need
                found_a.append(x[ok])
                found_b.append(y[ok])
    if not found_a:
        return np.arange(len(key))
    return _roots(len(key), np.concatenate(found_a), np.concatenate(found_b))


def _compare(need: int):
    """Links (u, v) of each bucket's nodes to a root."""

    def compare(table: pa.Table) -> pa.Table:
        path = flat(table["path"]).to_numpy()
        nodes = np.array(flat(table["node"]).to_pylist(), object)
        order = np.lexsort((nodes, path))
        path, nodes, tokens = path[order], nodes[order], _matrix(table["tokens"])[order]
        root = _group_roots(path, tokens, need)
        own = root == np.arange(len(root))
        return pa.table([pa.array(x.tolist(), pa.binary()) for x in (nodes[~own], nodes[root[~own]])], names=["u", "v"])

    return compare


def _children(level: int):
    """Each path extended by the token that it chooses at ``level``."""

    def extend(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            steps = np.frombuffer(b"".join(batch.column("steps").to_pylist()), np.uint16).reshape(-1, DEPTH, CHOICES)
            path = batch.column("path").to_numpy().view(U64)
            choice = _choice(path)
            new = _extended(path, choice, steps[np.arange(len(path)), level, choice])
            yield pa.record_batch([pa.array(new.view(np.int64)), batch.column("node"), batch.column("steps")], names=["path", "node", "steps"])

    return extend


def _sized(paths: DataFrame) -> DataFrame:
    """``paths`` (path, node, steps) that at least two nodes share, with the size of their bucket."""
    sizes = paths.groupBy("path").agg(F.count("*").alias("bucket")).filter("bucket > 1")
    return paths.join(sizes, "path")


def candidate_links(nodes: DataFrame, threshold: float, packs: int) -> DataFrame:
    """Links (u, v) between nodes (node, tokens, steps, paths) that are probably similar."""
    compare = _compare(least_equal(threshold))
    tokens = nodes.select("node", "tokens")
    width = 2 * DEPTH * CHOICES
    paths = nodes.select("node", "steps", F.posexplode("paths").alias("run", "path"))
    paths = paths.select("path", "node", F.expr(f"substring(steps, run * {width} + 1, {width})").alias("steps"))
    links: list[DataFrame] = []
    for level in range(DEPTH):
        sized = stored(_sized(paths).join(tokens, "node"), "paths")
        small = sized.filter(F.col("bucket") <= SMALL_BUCKET).select("path", "node", "tokens")
        packed = small.groupBy(F.pmod(F.col("path"), F.lit(packs)).alias("pack"))
        links.append(packed.applyInArrow(compare, "u binary, v binary"))
        large = sized.filter(F.col("bucket") > SMALL_BUCKET)
        if large.isEmpty():
            break
        if level == DEPTH - 1:  # what no path could part: all pairs of blocks
            blocks = F.ceil(F.col("bucket") / BLOCK)
            dealt = large.withColumn("block", F.pmod(F.xxhash64("node", "path"), blocks))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            split = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
            links.append(dealt.select("path", "node", "tokens", *split).groupBy("path", "low", "high").applyInArrow(compare, "u binary, v binary"))
            break
        paths = large.select("path", "node", "steps").mapInArrow(_children(level + 1), "path long, node binary, steps binary")
    return functools.reduce(DataFrame.unionByName, links).distinct()


def _sets(size: int):
    schema = pa.schema([("cluster", pa.binary()), ("node", pa.binary()), ("copies", pa.int64()), ("set", pa.binary())])

    def sets(batches):
        for table in text_batches(batches, "text", 1 << 20):
            words = words_of(flat(table["text"]), BLANK_SEPARATED)
            starts, sizes, counts = shingle_spans(words, size)
            hashes = span_hashes(words, starts, sizes)
            stop = np.cumsum(counts)
            ids = _node_ids(words)
            rows = []
            for k, (cluster, node, copies) in enumerate(
                zip(table["cluster"].to_pylist(), table["node"].to_pylist(), table["copies"].to_pylist(), strict=True)
            ):
                if ids[k].tobytes() == node:  # else another text with the same doc_id
                    rows.append((cluster, node, copies, np.unique(hashes[stop[k] - counts[k] : stop[k]]).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return sets


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    every, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for low in range(0, len(every), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        x = np.zeros((len(left) + len(right), min(4096, len(every) - low)), np.float32)
        x[row[a:b], column[a:b] - low] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out.astype(np.int64)


def _count(threshold: float):
    """Of each cluster in a pack, or of one pair of a cluster's blocks: links per node, and one link to a root."""
    scaled = round(threshold * 1000)

    def count(table: pa.Table) -> pa.Table:
        rows = sorted(
            zip(
                table["cluster"].to_pylist(),
                table["node"].to_pylist(),
                table["block"].to_pylist(),
                table["low"].to_pylist(),
                table["high"].to_pylist(),
                table["copies"].to_pylist(),
                table["set"].to_pylist(),
                strict=True,
            ),
            key=lambda r: (r[0], r[2], r[1]),
        )
        out: list[tuple[bytes, bytes, int]] = []
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            group = rows[at:end]
            at = end
            sets = [np.frombuffer(r[6], U64) for r in group]
            length = np.array([len(s) for s in sets])
            copies = np.array([r[5] for r in group])
            block = np.array([r[2] for r in group])
            same = group[0][3] == group[0][4]
            one = np.arange(len(group)) if same else np.flatnonzero(block == group[0][3])
            two = one if same else np.flatnonzero(block == group[0][4])
            if not len(one) or not len(two):
                continue
            both = _intersections([sets[i] for i in one], [sets[i] for i in two])
            union = length[one][:, None] + length[two][None, :] - both
            linked = 1000 * both >= scaled * union
            if same:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(group), np.int64)
            links[one] += linked @ copies[two]
            if not same:
                links[two] += linked.T @ copies[one]
            a, b = np.nonzero(linked)
            root = _roots(len(group), one[a], two[b])
            out.extend((group[i][1], group[root[i]][1], int(links[i])) for i in range(len(group)) if links[i])
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["u", "v", "links"])

    return count


def jaccard_classes(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id and n_links.

    ``n_links`` counts the other documents with a similarity of at least
    ``threshold``; ``class_id`` is the least doc_id of the documents that are
    linked with it, directly or through others.
    """
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, node binary, shingles long, tokens binary, steps binary, paths array<long>"
    signed = stored(rows.mapInArrow(_signed(size, runs_for(recall, threshold)), schema), "signed")
    real = signed.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = stored(
        real.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"),
            F.count("*").alias("copies"),
            F.first("shingles").alias("shingles"),
            F.first("tokens").alias("tokens"),
            F.first("steps").alias("steps"),
            F.first("paths").alias("paths"),
        ),
        "nodes",
    )
    total, shingles = nodes.agg(F.count("*"), F.sum("shingles")).first()
    packs = max(64, math.ceil(total / 2000))
    clusters = stored(components(candidate_links(nodes, threshold, packs)), "clusters")
    members = (
        nodes.select("node", "doc_id", "copies").join(clusters, "node").select("node", "doc_id", "copies", F.col("root").alias("cluster"))
    )
    sets = rows.join(members, "doc_id").select("cluster", "node", "copies", "text").mapInArrow(
        _sets(size), "cluster binary, node binary, copies long, set binary"
    )
    in_cluster = clusters.groupBy(F.col("root").alias("cluster")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    packs = max(64, math.ceil((shingles or 0) * 8 / (8 << 20)))
    dealt = (
        sets.dropDuplicates(["node"])
        .join(in_cluster, "cluster")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .withColumn(
            "pack",
            F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(packs)).cast("string")).otherwise(
                F.concat_ws("-", F.hex("cluster"), "low", "high")
            ),
        )
        .select("pack", "cluster", "node", "block", "low", "high", "copies", "set")
    )
    counted = stored(dealt.groupBy("pack").applyInArrow(_count(threshold), "u binary, v binary, links long"), "links")
    links = counted.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(counted.select("u", "v"))
    named = (
        nodes.select("node", "doc_id", "copies")
        .join(classes, "node", "left")
        .select("node", "doc_id", "copies", F.coalesce("root", "node").alias("root"))
    )
    class_id = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    per_node = (
        named.join(class_id, "root")
        .join(links, "node", "left")
        .select("node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    known = real.select("doc_id", "node").join(per_node, "node").select("doc_id", "class_id", "n_links")
    alone = signed.filter("node IS NULL OR doc_id IS NULL").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    return few_files(known.unionByName(alone))


def keep_one_of_each(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with the least doc_id of their class.

    Rows with a null doc_id stay; of rows equal in doc_id and text one stays;
    rows with one doc_id and different texts stay or go together.
    """
    names = docs.columns
    doc, text = f"_c{names.index('doc_id')}", f"_c{names.index('text')}"
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    kept = jaccard_classes(docs, size, threshold).filter("doc_id = class_id").groupBy(F.col("doc_id").alias("__kept"))
    kept = stored(kept.agg(F.count("*").alias("__times")), "kept")
    rows = plain.join(kept, F.col(doc).cast("long") == F.col("__kept"))
    single = rows.filter("__times = 1").select(plain.columns)
    if not kept.filter("__times > 1").isEmpty():
        again = rows.filter("__times > 1").select(plain.columns).withColumn("__text", F.xxhash64(text))
        single = single.unionByName(again.dropDuplicates([doc, "__text"]).drop("__text"))
    return few_files(single.unionByName(plain.filter(F.col(doc).isNull()))).toDF(*names)
