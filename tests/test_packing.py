"""Packing and budgets of split groups against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import corpus, packing


def brute_pack(values, limit):
    chunk, used, out = -1, 0, []
    for v in values:
        if chunk < 0 or used + v > limit:
            chunk, used = chunk + 1, v
        else:
            used += v
        out.append(chunk)
    return out, chunk, used


def brute_budget(values, room, least):
    used, out = 0, []
    for v in values:
        if used + v <= room:
            used += v
            out.append(("keep", v))
        elif used + least < room:
            out.append(("truncate", room - used))
            used = room
        else:
            out.append(("drop", 0))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_parts_compose(seed):
    """Any cut of any rows into parts gives the states and chunks of one pass."""
    rng = random.Random(seed)
    limit = rng.choice([1, 5, 20])
    groups = [(g, [rng.choice([0, 0, 1, 2, 3, 7, 19, 30]) for _ in range(rng.randrange(1, 40))]) for g in range(rng.randrange(1, 5))]
    rows = [(g, v) for g, values in groups for v in values]
    cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randrange(0, 9)))) if len(rows) > 1 else []
    pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    import pyarrow as pa

    parts = []
    for n, piece in enumerate(pieces):
        table = pa.table({"__part": [n] * len(piece), "__at": list(range(len(piece))), "__key": [g for g, _ in piece], "__tokens": [v for _, v in piece]})
        parts += packing._summarise(limit)(table).to_pylist()
    starts = packing.starts_of(parts, limit)
    found = []
    for n, piece in enumerate(pieces):
        key, state = piece[0][0], starts[n]
        at = 0
        while at < len(piece):
            end = next((k for k in range(at, len(piece)) if piece[k][0] != piece[at][0]), len(piece))
            if piece[at][0] != key:
                key, state = piece[at][0], (-1, 0)
            chunks, *after = packing.packed_from(np.array([v for _, v in piece[at:end]]), limit, *state)
            found += chunks.tolist()
            state, at = tuple(after), end
    assert found == [c for _, values in groups for c in brute_pack(values, limit)[0]]


@pytest.mark.parametrize("limit", [10, 100])
def test_packing_of_one_large_group(spark, limit):
    rng = random.Random(limit)
    data = [(i, None if i % 3 == 0 else "g" if i % 3 == 1 else f"s{i % 7}", rng.choice([0, 1, 4, 9, 40, 200])) for i in range(900)]
    frame = spark.createDataFrame(data, "k long, g string, tokens long").repartition(5)
    found = {r.k: r.chunk for r in corpus.pack_chunks(frame, ["g"], ["k"], "tokens", limit, "k", split=True).collect()}
    plain = {r.k: r.chunk for r in corpus.pack_chunks(frame, ["g"], ["k"], "tokens", limit, "k").collect()}
    expected = {}
    for g in {d[1] for d in data}:
        own = [d for d in data if d[1] == g]
        expected.update(zip([d[0] for d in own], brute_pack([d[2] for d in own], limit)[0], strict=True))
    assert found == plain == expected


@pytest.mark.parametrize("budget", [1000, 1040, 1101, 1500, 4000, 10**7])
def test_budgets_of_large_groups(spark, budget):
    rng = random.Random(budget)
    data = [(i, "hot" if i % 3 else None, float(rng.randrange(9)), rng.choice([0, 1, 4, 9, 40, 130])) for i in range(400)]
    frame = spark.createDataFrame(data, "k long, g string, importance double, tokens long").repartition(5)
    found = {r.k: (r.action, r.used) for r in corpus.enforce_budget(frame, ["g"], "importance", "k", "tokens", budget).collect()}
    expected = {}
    for g in ("hot", None):
        own = sorted([d for d in data if d[1] == g], key=lambda d: (-d[2], d[0]))
        expected.update(zip([d[0] for d in own], brute_budget([d[3] for d in own], max(0, budget - corpus.RESERVE), corpus.MIN_PARTIAL), strict=True))
    assert found == expected


def test_empty(spark):
    none = spark.createDataFrame([], "k long, g string, importance double, tokens long")
    assert corpus.pack_chunks(none, ["g"], ["k"], "tokens", 5, "k", split=True).isEmpty()
    assert corpus.enforce_budget(none, ["g"], "importance", "k", "tokens", 5000).select(F.col("action")).isEmpty()
