"""Periodic runs: stretches of a text's words that repeat with a short period, found by block convolution.

At scale B the words are cut into blocks of B. A run of a period d from B to 2B that comes at least four times holds
two whole blocks side by side whose copies lie d words further on, in the window that follows. The sum of squared differences between a
block and every place of its window is one cyclic convolution, done by a number-theoretic transform: exact whole numbers modulo a
prime, zero wherever block and place agree. Each such distance is a seed, which is extended to both sides word by word; so a sum
that only the modulus makes zero adds nothing. Blocks with a word that does not come again within the window have no copy and are not transformed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: 15 * 2**27 + 1; 31 generates its units. Products of two residues fit in 64 bits, transforms may have 2**27 places.
PRIME, UNIT = 2013265921, 31
MIN_COPIES = 4
MIN_WORDS = 6
BATCH_WORDS = 400_000
TRANSFORM_PLACES = 1 << 19
NEVER = 1 << 40

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


@lru_cache(maxsize=128)
def _powers(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of this order."""
    root = pow(UNIT, (PRIME - 1) // size, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    powers = np.ones(max(1, size // 2), np.int64)
    done, step = 1, root
    while done < len(powers):
        powers[done : 2 * done] = powers[:done] * step % PRIME
        step, done = step * step % PRIME, 2 * done
    return powers


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row; the inverse leaves the factor of the row length in."""
    many, size = rows.shape
    left, stride = size, 1
    while left > 1:
        half = left // 2
        rows = rows.reshape(many, left, stride)
        low, high = rows[:, :half], rows[:, half:]
        out = np.empty((many, half, 2, stride), np.int64)
        np.add(low, high, out=out[:, :, 0])
        out[:, :, 0] %= PRIME
        np.multiply(low - high, _powers(left, inverse)[:, None], out=out[:, :, 1])
        out[:, :, 1] %= PRIME
        rows, left, stride = out, half, 2 * stride
    return rows.reshape(many, size)


def zero_mismatches(codes: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For blocks at ``starts``: where they come again, as (index of the block, distance) with distances from ``block`` to twice that, less one."""
    size = 2 * block
    found = []
    for first in range(0, len(starts), max(1, TRANSFORM_PLACES // size)):
        at = starts[first : first + max(1, TRANSFORM_PLACES // size), None]
        pattern = np.zeros((len(at), size), np.int64)
        pattern[:, :block] = codes[at + np.arange(block - 1, -1, -1)]
        window = codes[at + np.arange(block, 3 * block)]
        products = transform(transform(pattern) * transform(window) % PRIME, inverse=True)[:, block - 1 : 2 * block - 1]
        squares = np.zeros((len(at), size + 1), np.int64)
        np.cumsum(window * window % PRIME, axis=1, out=squares[:, 1:])
        own = (pattern * pattern % PRIME).sum(axis=1)[:, None]
        both = own + squares[:, block : 2 * block] - squares[:, :block]
        twice = products * (2 * pow(size, -1, PRIME) % PRIME) % PRIME
        index, offset = np.nonzero((both - twice) % PRIME == 0)
        found.append((index + first, offset + block))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([d for _, d in found])


def _stretch(codes: np.ndarray, start: int, stop: int, shift: int) -> tuple[int, int]:
    """The longest stretch around [start, stop) whose words equal those ``shift`` further on."""
    step = 64
    while stop + shift < len(codes):
        wrong = codes[stop : min(stop + step, len(codes) - shift)] != codes[stop + shift : stop + shift + step]
        if wrong.any():
            stop += int(wrong.argmax())
            break
        stop, step = stop + len(wrong), 2 * step
    step = 64
    while start > 0:
        low = max(0, start - step)
        wrong = codes[low:start] != codes[low + shift : start + shift]
        if wrong.any():
            start -= int(wrong[::-1].argmax())
            break
        start, step = low, 2 * step
    return start, stop


def find_runs(codes: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Rows (start, length, period) by start, then period, of all runs in a sequence of whole numbers from 0 on.

    ``longest`` bounds the length of a run, where sequences are strung together with numbers of their own between them.
    """
    size, longest = len(codes), len(codes) if longest is None else longest
    order = np.argsort(codes, kind="stable")
    again = np.full(size, NEVER)
    same = codes[order[1:]] == codes[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    scales = max(0, (longest // MIN_COPIES).bit_length())
    past = 3 << scales
    padded = np.concatenate([codes, (codes.max() if size else 0) + 1 + np.arange(past)])
    runs: list[tuple[int, int, int]] = []
    block, latest = 1, again
    for _ in range(scales):
        near = latest < 2 * block
        beside = np.zeros(len(near) + 2, bool)
        beside[:-2] = near
        beside[2:] |= near
        starts = np.flatnonzero(near & beside[1:-1]) * block
        if len(starts):
            ends = _covered(runs, starts)
            starts, ends = starts[ends < starts + 3 * block], ends[ends < starts + 3 * block]
            index, shift = zero_mismatches(padded, starts, block)
            inside = starts[index] + shift + block <= ends[index]  # a multiple of a known run's period
            runs += _extended(padded, starts[index[~inside]], shift[~inside], block)
        even = len(latest) // 2 * 2
        latest = np.maximum(latest[0:even:2], latest[1:even:2])
        block *= 2
    return np.array(sorted(runs), np.int64).reshape(-1, 3)


def _covered(runs: list[tuple[int, int, int]], starts: np.ndarray) -> np.ndarray:
    """For each place the furthest end of a known run that begins there or before."""
    if not runs:
        return np.zeros(len(starts), np.int64)
    known = np.array(sorted(runs), np.int64)
    reach = np.concatenate([[0], np.maximum.accumulate(known[:, 0] + known[:, 1])])
    return reach[np.searchsorted(known[:, 0], starts, side="right")]


def _extended(codes: np.ndarray, starts: np.ndarray, shifts: np.ndarray, block: int) -> list[tuple[int, int, int]]:
    """The runs around seeds; a seed counts only if the block before or after it is one too."""
    order = np.lexsort((starts, shifts))
    starts, shifts = starts[order], shifts[order]
    follows = np.zeros(len(starts) + 1, bool)
    follows[1:-1] = (shifts[1:] == shifts[:-1]) & (starts[1:] == starts[:-1] + block)
    pairs = follows[:-1] | follows[1:]
    runs, at, until = [], -1, 0
    for start, shift in zip(starts[pairs].tolist(), shifts[pairs].tolist(), strict=True):
        if shift == at and start < until:
            continue
        low, high = _stretch(codes, start, start + block, shift)
        at, until = shift, high
        if high - low + shift >= max(MIN_WORDS, MIN_COPIES * shift):
            runs.append((low, high - low + shift, shift))
    return runs


def _of_texts(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, bytes]]:
    """The runs of each text, given as its words, and the text without the words after each run's first period."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    borders = np.cumsum(sizes + 1)
    codes = np.empty(int(borders[-1]) if texts else 0, np.int64)
    for words, end in zip(texts, borders.tolist(), strict=True):
        codes[end - 1 - len(words) : end - 1] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    codes[borders - 1] = len(number) + np.arange(len(texts))
    runs = find_runs(codes, int(sizes.max(initial=0)))
    owner = np.searchsorted(borders, runs[:, 0], side="right")
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i, words in enumerate(texts):
        own = runs[cuts[i] : cuts[i + 1]]
        if len(own):
            own = own - [borders[i] - 1 - sizes[i], 0, 0]
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, own[:, 0] + own[:, 2], 1)
            np.add.at(change, own[:, 0] + own[:, 1], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        yield own, b" ".join(words)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``runs`` (start and length in words, period) and ``collapsed``.

    Words are separated by white space of ASCII. A run has at least four copies of its period and at least six words, and no word next to
    it goes on with it; its period is the shortest one. Runs are sorted by start, then period. ``collapsed`` holds the words,
    joined by spaces, that no run contains after its first period. Null, empty and blank texts have no words and no runs; a null
    id stays null; rows that come again are judged one by one; an empty table gives no rows; other columns are not read.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, waiting, held = 0, [], 0
            for row in range(batch.num_rows):
                waiting.append((batch.column("text")[row].as_py() or "").encode().split())
                held += len(waiting[-1])
                if held >= BATCH_WORDS or row + 1 == batch.num_rows:
                    yield _as_batch(batch.column("doc_id").slice(start, len(waiting)), waiting)
                    start, waiting, held = row + 1, [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def _as_batch(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
    found = list(_of_texts(texts))
    offsets = np.concatenate([[0], np.cumsum([len(runs) for runs, _ in found])]).astype(np.int32)
    every = np.concatenate([runs for runs, _ in found])
    structs = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], ["start", "length", "period"])
    collapsed = pa.array([text for _, text in found], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(offsets, structs), collapsed],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def run_report(found: DataFrame) -> DataFrame:
    """``found`` with digests, and the run of the greatest exponent (length / period; ties: smallest start, then period)."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length / r.period AS exponent, -r.start AS start, -r.period AS period, r.length AS length)))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.expr("-_best.start").alias("start"), F.col("_best.length").alias("length"), F.expr("-_best.period").alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words",
    )


__all__ = ["find_runs", "periodic_runs", "run_report", "transform", "zero_mismatches"]
