"""Pack token sequences into bins of a fixed size by minimum bin slack.

Only the counts of piece lengths decide the plan, and there are at most as many lengths as a bin has
places, whatever the corpus size. For each bin the longest length left is taken, and a bitset
subset-sum over the other lengths finds the combination that fills the bin best. It is used as
often as the counts allow and removed. Pieces then find their place by their rank among pieces of
their length; ranks come from counts per block of pieces, so a length that very many pieces share is spread over tasks.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from leakscan.llm.bpe import CACHE_PIECES, PRETOKEN, UNEVEN, UnitCache, Vocabulary, cut_specials
from leakscan.llm.common import materialize, partitions

CAPACITY = 1024
END = 2


class TokenIds:
    """Ids of a text as little-endian 32-bit numbers, as the tokenizers library gives them for the file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        vocabulary = Vocabulary(path)
        if vocabulary.ordered:  # the ids are ranks, which the faster library takes
            encode = tiktoken.Encoding("ids", pat_str=PRETOKEN, mergeable_ranks=vocabulary.ids, special_tokens={}).encode_ordinary
        else:
            library = Tokenizer.from_file(path)
            encode = lambda text: library.encode(text, add_special_tokens=False).ids
        self.encode = lambda text: array("I", encode(text)).tobytes()
        self.by_piece = UnitCache(lambda piece: self.encode(" " + piece), CACHE_PIECES)
        self.specials, self.special_ids = vocabulary.specials, vocabulary.special_ids

    def ordinary(self, text: str) -> bytes:
        if UNEVEN.search(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        return self.encode(first) + b"".join(map(self.by_piece.__getitem__, rest))

    def of(self, text: str) -> bytes:
        pieces = cut_specials(text, self.specials)
        return b"".join(self.special_ids[p] if i % 2 else self.ordinary(p) for i, p in enumerate(pieces))


def _pieces(path: str, capacity: int, end: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TokenIds(path)
        tail = np.asarray([end], "<u4").tobytes()
        for batch in batches:
            source, numbers, starts, lengths, sums = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                data = ids.of(text.as_py() or "") + tail
                total = len(data) // 4
                first = total if total <= capacity else total % capacity or capacity
                start, stop, number = 0, first, 0
                while start < total:
                    source.append(row)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(stop - start)
                    sums.append(zlib.crc32(data[4 * start : 4 * stop]))
                    start, stop, number = stop, stop + capacity, number + 1
            columns = [pa.array(numbers, pa.int32()), *[pa.array(c, pa.int64()) for c in (starts, lengths, sums)]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(source, pa.int64())), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest length there is, with the lengths that fill the rest of a bin best; how often each is used."""
    seed = max(counts)
    room = capacity - seed
    rest = counts | {seed: counts[seed] - 1}
    left = sorted(((n, c) for n, c in rest.items() if c > 0 and n <= room), reverse=True)
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, count in left:
        many, most = 1, min(count, room // length)
        while most > 0:  # 1, 2, 4 ... copies at a time
            many = min(many, most)
            new = (reach | reach << many * length) & full
            if new != reach:
                steps.append((length, many, reach))
                reach = new
            most -= many
            many *= 2
        if reach >> room & 1:
            break
    place, used = reach.bit_length() - 1, {seed: 1}
    for length, many, before in reversed(steps):
        if not before >> place & 1:
            place -= many * length
            used[length] = used.get(length, 0) + many
    return used


def bin_plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int, int]]:
    """Combinations, how often each is used, and the number of its first bin."""
    left, plan, bins = {n: c for n, c in counts.items() if c}, [], 0
    while left:
        used = fullest(left, capacity)
        times = min(left[n] // k for n, k in used.items())
        plan.append((used, times, bins))
        bins += times
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return plan


def _slots(plan) -> list[tuple[int, int, int, int, int, int]]:
    """For each combination and length in it: ranks from and to, copies in a bin, first bin, place in the bin."""
    seen: dict[int, int] = {}
    rows = []
    for used, times, first in plan:
        place = 0
        for length in sorted(used, reverse=True):
            low = seen.get(length, 0)
            seen[length] = high = low + used[length] * times
            rows.append((length, low, high, used[length], first, place))
            place += used[length] * length
    return rows


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``docs`` as pieces of at most ``capacity`` tokens with their place: one row per piece.

    A document is its token ids, then ``end``. Longer ones are cut so that only their first piece may be shorter than a
    bin. Null and empty texts are one token. Repeated rows are packed one by one, ids are carried along; an
    empty table gives no rows. The plan is made of at most ``capacity`` length counts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, end), schema)
    blocks = max(1, partitions(docs))
    pieces = materialize(pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int")), "pieces")
    sums = materialize(pieces.groupBy("length", "block").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = pieces.sparkSession.createDataFrame(_slots(bin_plan(counts, capacity)), "length long, low long, high long, copies long, first long, place long")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("order", F.row_number().over(within) - 1).join(bases, ["length", "block"]).withColumn("rank", F.col("order") + F.col("base"))
    placed = ranked.join(F.broadcast(slots), "length").where("rank >= low and rank < high")
    step = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.expr("(rank - low) div copies")).alias("sequence_id"),
        (F.col("place") + (step % F.col("copies")) * F.col("length")).alias("offset"),
    )


__all__ = ["bin_plan", "fullest", "pack"]
