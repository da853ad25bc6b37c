"""Crowded cells dealt into blocks: the same matches, and no vector is repeated for the others it meets."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leakscan import SearchLimits, SplitPair, audit_split
from leakscan.operators import blocks, match
from leakscan.scratch import materialize

IN_BLOCKS = {"chunk_rows": 2, "min_pair_budget": 1, "pairs_per_vector": 0, "min_copies": 0, "copies_per_vector": 0, "block_rows": 5}
PATHS = {
    "by cell": SearchLimits(**IN_BLOCKS, max_levels=1, block_meetings=10**6),
    "cells": SearchLimits(**IN_BLOCKS, max_levels=1, block_meetings=4, broadcast_rows=0),
    "all with all": SearchLimits(**IN_BLOCKS, max_levels=1, block_meetings=0),
    "levels": SearchLimits(**IN_BLOCKS, max_levels=4, block_meetings=8),
}


def rows(rng, n, width, atol):
    """Values with many ties, negative, huge and zero ones, in two categories."""
    made = []
    for i in range(n):
        kind = rng.random()
        values = rng.integers(-3, 4, width) * (atol / 2) if kind < 0.6 else rng.normal(0, 2 * atol, width)
        if kind > 0.9:
            values = values + rng.choice([1e12, -1e12, -0.0])
        made.append((i, str(rng.choice(["a", "a", "b"])), *[float(v) for v in values]))
    return made


def brute_force(train, test, atol):
    found = {}
    for i, kind, *values in test:
        near = [(max(abs(a - b) for a, b in zip(values, other, strict=True)), j) for j, c, *other in train if c == kind]
        if near and min(near)[0] <= atol:
            found[i] = min(near)
    return found


@pytest.mark.parametrize("path", PATHS)
def test_blocks_equal_brute_force(spark, monkeypatch, path, width=3, atol=0.5):
    rng = np.random.default_rng(1)
    train, test = rows(rng, 80, width, atol), rows(rng, 40, width, atol)
    monkeypatch.setattr(match, "BLOCK_COPY_COST", 1.0 if path in ("cells", "levels") else match.BLOCK_COPY_COST)
    calls = []
    monkeypatch.setattr(match.blocks, "met", lambda *a, f=blocks.met: calls.append(a[2]) or f(*a))
    schema = "id bigint, c string, " + ", ".join(f"x{j} double" for j in range(width))
    pair = SplitPair(*[spark.createDataFrame(side, schema).repartition(3) for side in (train, test)])
    found = audit_split(pair, [f"x{j}" for j in range(width)] + ["c"], near_atol=atol, id_columns=["id"], limits=PATHS[path]).row_matches.collect()
    assert {r.test_id: (r.distance, r.train_id) for r in found} == brute_force(train, test, atol) and len(found) == len({r.test_id for r in found})
    assert calls and {"by cell": all(calls), "all with all": not any(calls)}.get(path, True)


@pytest.mark.parametrize("missing, together, block_rows", [(4, 10**6, 1), (2, 0, 1), (4, 0, 100)])
def test_a_missing_id_is_the_lowest_in_blocks_too(spark, missing, together, block_rows):
    train = spark.createDataFrame([(None if x == missing else x, float(x)) for x in (2, 4, 8, 16)], "i bigint, x double")
    test = spark.createDataFrame([(9, 3.0), (9, 3.0), (10, 12.0), (None, 30.0)], "i bigint, x double")
    limits = SearchLimits(**IN_BLOCKS | {"chunk_rows": 1, "block_rows": block_rows}, max_levels=1, block_meetings=together)
    found = audit_split(SplitPair(train, test), ["x"], near_atol=4.0, id_columns=["i"], limits=limits).row_matches.collect()
    assert sorted(((r.test_id, r.train_id, r.distance) for r in found), key=str) == [(10, 8, 4.0), (9, None, 1.0), (9, None, 1.0)]


@pytest.mark.parametrize("together", [10**6, 0])
def test_vectors_are_written_and_shuffled_once_however_many_they_meet(spark, monkeypatch, together):
    wide = spark.range(900).select(F.col("id"), *[F.expr(f"CAST(pmod(hash(id, {j}), 1000) AS double) / 1000 AS x{j}") for j in range(4)])
    written = {}

    def recorded(df, name, *rest):
        table = materialize(df, name, *rest)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        written.setdefault(name, []).append((table, plan))
        return table

    monkeypatch.setattr(match, "materialize", recorded)
    monkeypatch.setattr(blocks, "materialize", recorded)
    monkeypatch.setattr(match, "discard", lambda *tables: None)
    limits = SearchLimits(**IN_BLOCKS | {"chunk_rows": 8}, max_levels=1, block_meetings=together)
    pair = SplitPair(wide.where("id % 3 > 0"), wide.where("id % 3 = 0"))
    found = audit_split(pair, [f"x{j}" for j in range(4)], near_atol=0.3, id_columns=["id"], limits=limits).row_matches.collect()
    everything = wide.toPandas().to_numpy()
    tests, trains = everything[everything[:, 0] % 3 == 0], everything[everything[:, 0] % 3 > 0]
    least = np.abs(tests[:, None, 1:] - trains[None, :, 1:]).max(axis=2).min(axis=1)
    assert len(found) == (least <= 0.3).sum() and np.allclose(sorted(r.distance for r in found), np.sort(least[least <= 0.3]))
    held = sum(len(r.rows) // 8 for table, _ in written["blocks"] for r in table.collect())
    assert 900 <= held <= 900 * 4  # a test vector enters at most two cells per grid column
    for name in ("blocks", "near", "least"):
        assert all("explode(sequence" not in plan for _, plan in written[name])


def packed(values, rows):
    names = [f"x{j}" for j in range(values.shape[1])]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(len(rows), np.int64)), pa.array(np.zeros(len(rows), np.int32)), pa.array(rows), *[pa.array(values[:, j]) for j in range(len(names))]],
        ["_cell", "_block", "row", *names],
    )
    return list(blocks._packed(names)(iter([batch.slice(0, 3), batch.slice(3)])))


@pytest.mark.parametrize("single", [True, False])
def test_a_block_keeps_values_exactly_and_in_single_precision_if_it_can(single):
    values = np.array([[0.1, -0.0], [1e300 if not single else 3.0, 2.5], [-7.0, 1e-30], [2.0**24 + 1, 1.0]])
    values = values.astype(np.float32).astype(np.float64) if single else values
    (block,) = packed(values, np.arange(4) + 2**40)
    batch = pa.RecordBatch.from_arrays([block.column("rows"), block.column("points")], ["test_rows", "test_points"])
    rows_, points = blocks._block(batch, "test", 0, 2)
    assert np.array_equal(points, values) and rows_.tolist() == (np.arange(4) + 2**40).tolist()
    assert block.column("points")[0].as_buffer().size == 4 * 2 * (4 if single else 8)


@pytest.mark.parametrize("width", [1, 2, 40])
@pytest.mark.parametrize("radius", [0.0, 0.25, 3.0, 1e200])
def test_meeting_of_blocks_larger_than_its_parts(monkeypatch, width, radius):
    monkeypatch.setattr(blocks, "TRAIN_ROWS", 192)
    monkeypatch.setattr(blocks, "TEST_ROWS", 7)
    monkeypatch.setattr(blocks, "VALUES", 64)
    rng = np.random.default_rng(width)
    tests, trains = rng.integers(-8, 9, (50, width)) / 8, rng.integers(-8, 9, (421, width)) / 8
    trains[:20] = tests[:20] + radius
    tests[-1], trains[-1] = 1e200, -1e200
    best = np.full(50, radius)
    best[::3] = radius / 2
    distance, place = blocks._nearest(tests, trains, best, [radius + (radius + 1e200) * 2.0**-45 if radius == 1e200 else radius + 1e-9] * width)
    gaps = np.abs(tests[:, None] - trains[None]).max(axis=2)
    hit = gaps.min(axis=1) <= best
    assert np.array_equal(place >= 0, hit) and hit.any()
    assert np.array_equal(distance[hit], gaps.min(axis=1)[hit]) and np.array_equal(place[hit], gaps.argmin(axis=1)[hit])
