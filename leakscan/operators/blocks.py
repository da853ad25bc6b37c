"""Vectors of crowded grid cells, compared block by block.

Repeating each vector for every chunk that it meets takes disk that grows with the candidate pairs. Here a cell is dealt into
blocks, and a block is one row that holds its vectors as bytes: a vector is shuffled and written once per cell that it
enters, however many others it meets. Two blocks meet in a task that reads both tables.

Within a meeting, a bit map per column and interval tells which train vectors lie within the radius along that column. The maps of
all columns are combined, 64 train vectors at a time, and only what is left is compared by value. Cell bounds of the maps are
padded like those of the grid, and the comparison is that of ``grid.within``, so the result is exact.

Functions of this module travel to Python workers by value, so executors need no copy of the package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from leakscan.functions import grid
from leakscan.scratch import materialize, with_settings
from leakscan.settings import BLOCK_BYTES, BLOCK_SCAN_BYTES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Intervals of a column, and train and test vectors whose bits are combined at once: these stay in a core's cache.
INTERVALS = 64
TRAIN_ROWS = 8192
TEST_ROWS = 128
#: Values of either side that are compared at once.
VALUES = 1 << 21


def rows_per_block(width: int, most: int) -> int:
    return max(1, min(most, BLOCK_BYTES // (8 * width)))


def blocks(entries: DataFrame, row: str, numeric: Sequence[str], parts: int, order: Sequence[Column] = ()) -> DataFrame:
    """One row per ``_cell`` and ``_block`` of ``entries``: the numbers in ``row`` and the vectors, both in the given order."""
    dealt = entries.repartition(parts, "_cell", "_block").sortWithinPartitions("_cell", "_block", *order)
    return dealt.select("_cell", "_block", F.col(row).alias("row"), *numeric).mapInArrow(
        _packed(tuple(numeric)), "_cell long, _block int, rows binary, points binary"
    )


def _packed(numeric: Sequence[str]) -> Callable:
    def block(key: tuple[int, int], held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = np.concatenate([piece.column("row").to_numpy() for piece in held])
        points = np.column_stack([np.concatenate([piece.column(name).to_numpy() for piece in held]) for name in numeric])
        with np.errstate(over="ignore"):
            single = points.astype(np.float32)
        if np.array_equal(single, points):
            points = single
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([rows.tobytes()], pa.binary()), pa.array([points.tobytes()], pa.binary())],
            ["_cell", "_block", "rows", "points"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, number = batch.column("_cell").to_numpy(), batch.column("_block").to_numpy()
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (number[1:] != number[:-1])) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                here = (int(cell[start]), int(number[start]))
                if held and here != key:
                    yield block(key, held)
                    held = []
                key = here
                held.append(batch.slice(start, stop - start))
        if held:
            yield block(key, held)

    return pack


def met(tests: DataFrame, trains: DataFrame, within_cell: bool, radius: float, largest: Sequence[float]) -> DataFrame:
    """``_test, _train, distance``: nearest train vectors within the radius, from every two blocks that meet. Written.

    ``within_cell`` joins blocks of equal cells, so that all meetings of a cell lie in one task. Else every test block meets every
    train block; tasks read the written tables again for it, and nothing is shuffled.
    """
    spark = tests.sparkSession
    left = tests.selectExpr("_cell", "_block AS block", "rows AS test_rows", "points AS test_points")
    right = trains.selectExpr("_cell AS cell", "rows AS train_rows", "points AS train_points")
    if within_cell:
        pairs = left.join(right, F.col("_cell") == F.col("cell"))
    else:
        pairs = left.crossJoin(right.hint("shuffle_replicate_nl"))
    pads = [grid.padding(radius, size + radius) for size in largest]
    found = pairs.select("_cell", "block", "test_rows", "test_points", "train_rows", "train_points").mapInArrow(
        _compared(radius, pads), "_test long, _train long, distance double"
    )
    few = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.files.maxPartitionBytes": str(BLOCK_SCAN_BYTES)}
    with with_settings(spark, few):
        return materialize(found, "met")


def _compared(radius: float, pads: Sequence[float]) -> Callable:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, best, hits = None, None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                here = (batch.column("_cell")[i].as_py(), batch.column("block")[i].as_py())
                if here != key:
                    if hits:
                        yield _settled(rows, best, hits)
                    key, hits = here, []
                    rows, tests = _block(batch, "test", i, len(pads))
                    best = np.full(len(rows), radius)
                train_rows, trains = _block(batch, "train", i, len(pads))
                distance, place = _nearest(tests, trains, best, pads)
                near = np.flatnonzero(place >= 0)
                best[near] = distance[near]
                if len(near):
                    hits.append((near, train_rows[place[near]], distance[near]))
        if hits:
            yield _settled(rows, best, hits)

    return compare


def _block(batch: pa.RecordBatch, side: str, i: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(batch.column(f"{side}_rows")[i].as_buffer(), np.int64)
    points = batch.column(f"{side}_points")[i].as_buffer()
    kind = np.float32 if points.size == 4 * width * len(rows) else np.float64
    return rows, np.frombuffer(points, kind).reshape(len(rows), width).astype(np.float64)


def _settled(rows: np.ndarray, best: np.ndarray, hits: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """The hits at the least distance; equally near ones of other blocks all stay."""
    test, train, distance = (np.concatenate(part) for part in zip(*hits, strict=True))
    least = distance == best[test]
    return pa.RecordBatch.from_pydict({"_test": rows[test[least]], "_train": train[least], "distance": distance[least]})


def _nearest(tests: np.ndarray, trains: np.ndarray, best: np.ndarray, pads: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Per test vector the least distance to a train vector, if it is at most ``best``, and the first place at it, else -1."""
    columns, inner = [], range(1, INTERVALS)
    for i, pad in enumerate(pads):
        ordered = np.sort(trains[:, i])
        edges = np.unique(ordered[[len(ordered) * k // INTERVALS for k in inner]])
        own = np.searchsorted(edges, trains[:, i], "right").astype(np.uint8)
        with np.errstate(over="ignore"):
            low, high = np.searchsorted(edges, tests[:, i] - pad, "right"), np.searchsorted(edges, tests[:, i] + pad, "right")
        code = low * INTERVALS + high
        seen = np.zeros(INTERVALS * INTERVALS, bool)
        seen[code] = True
        spans = np.flatnonzero(seen)
        columns.append((float(np.mean(high - low) / (len(edges) + 1)), own, spans // INTERVALS, spans % INTERVALS, (np.cumsum(seen) - 1)[code]))
    columns = [column[1:] for column in sorted(columns, key=lambda column: column[0])]
    distance, place = np.full(len(tests), np.inf), np.full(len(tests), -1)
    for start in range(0, len(trains), TRAIN_ROWS):
        some = trains[start : start + TRAIN_ROWS]
        spare = -len(some) % 64
        maps = []
        for own, low, high, _ in columns:
            cells = np.append(own[start : start + TRAIN_ROWS], np.full(spare, INTERVALS, np.uint8))
            upto = np.packbits(cells < np.arange(INTERVALS + 1, dtype=np.uint8)[:, None], axis=1).view(np.uint64)
            maps.append(upto[high + 1] & ~upto[low])
        for first in range(0, len(tests), TEST_ROWS):
            part = slice(first, first + TEST_ROWS)
            test, train = _left_over(maps, [spans[part] for *_, spans in columns])
            test += first
            _keep_least(distance, place, test, train + start, _distances(tests, test, some, train), best)
    return distance, place


def _left_over(maps: list[np.ndarray], spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no column rules out, ordered by test and train."""
    bits = maps[0][spans[0]]
    more = np.empty_like(bits)
    for bitmap, span in zip(maps[1:], spans[1:], strict=True):
        np.take(bitmap, span, axis=0, out=more, mode="clip")
        np.bitwise_and(bits, more, out=bits)
    test, word = np.nonzero(bits)
    which, bit = np.nonzero(np.unpackbits(bits[test, word].view(np.uint8).reshape(-1, 8), axis=1))
    return test[which], word[which] * 64 + bit


def _distances(tests: np.ndarray, test: np.ndarray, trains: np.ndarray, train: np.ndarray) -> np.ndarray:
    step = max(1, VALUES // tests.shape[1])
    found = [np.zeros(0)]
    with np.errstate(over="ignore"):
        for at in range(0, len(test), step):
            gaps = tests[test[at : at + step]]
            gaps -= trains[train[at : at + step]]
            found.append(np.abs(gaps, out=gaps).max(axis=1))
    return np.concatenate(found)


def _keep_least(distance: np.ndarray, place: np.ndarray, test: np.ndarray, train: np.ndarray, gap: np.ndarray, best: np.ndarray) -> None:
    """Takes in pairs, ordered by test and train, that are no farther than ``best`` and nearer than what is kept."""
    near = np.flatnonzero((gap <= best[test]) & (gap < distance[test]))
    if not len(near):
        return
    test, train, gap = test[near], train[near], gap[near]
    starts = np.flatnonzero(np.append(True, test[1:] != test[:-1]))
    least = np.minimum.reduceat(gap, starts)
    at = np.flatnonzero(gap == np.repeat(least, np.diff(np.append(starts, len(test)))))
    at = at[np.append(True, test[at][1:] != test[at][:-1])]
    distance[test[at]], place[test[at]] = gap[at], train[at]
