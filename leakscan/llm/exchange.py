"""Batches of texts that ask all of a corpus about many 64-bit keys, in compact messages.

A batch is one row that holds some megabytes of documents, compressed. It sends each key range one message with
its sorted distinct keys. A task per key range merges the messages and answers each in the order of
its keys. One message stands for thousands of keys, so a shuffle carries about 6 bytes per key
instead of a row per key, and a key that is everywhere arrives once per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leakscan.llm.common import materialize

BATCH_BYTES = 4 << 20
BATCH_ROWS = 20_000
_CODEC = "zstd"


def pack_numbers(values: np.ndarray) -> bytes:
    """64-bit numbers, compressed by byte planes."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, _CODEC, asbytes=True)


def unpack_numbers(data: bytes) -> np.ndarray:
    count = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * count, _CODEC, asbytes=True), np.uint8).reshape(8, count)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(count)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data), dtype=np.uint64)


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def text_batches(docs: DataFrame) -> DataFrame:
    """``batch`` and ``data`` (a packed table of ``doc_id`` and binary ``text``, null as null), written once."""

    def gather(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0

        def row():
            return pa.RecordBatch.from_pydict({"data": pa.array([pack_table(pa.Table.from_batches(held).combine_chunks())], pa.binary())})

        for batch in stream:
            lengths = np.asarray(batch.column("size"))
            start, running = 0, np.cumsum(lengths)
            while start < batch.num_rows:
                room = BATCH_BYTES - size + (running[start - 1] if start else 0)
                stop = max(start + 1, int(np.searchsorted(running, room, "right")))
                stop = min(stop, start + BATCH_ROWS - rows, batch.num_rows)
                held.append(batch.select(["doc_id", "text"]).slice(start, stop - start))
                size, rows, start = size + int(lengths[start:stop].sum()), rows + stop - start, stop
                if size >= BATCH_BYTES or rows >= BATCH_ROWS:
                    yield row()
                    held, size, rows = [], 0, 0
        if held:
            yield row()

    text = F.col("text").cast("binary")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size"))
    rows = sized.mapInArrow(gather, "data binary").withColumn("batch", F.monotonically_increasing_id())
    return materialize(rows, "batches")


def ranges_for(batches: DataFrame) -> int:
    """Number of key ranges: as many as the session's shuffle partitions."""
    return max(1, int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_ranges(keys: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    """Key ranges of sorted keys that hold some of them."""
    width = (1 << 64) // ranges + 1
    cuts = np.searchsorted(keys, np.array([i * width for i in range(1, ranges)], np.uint64))
    bounds = [0, *cuts.tolist(), len(keys)]
    return [(i, slice(a, b)) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]


def ask(batches: DataFrame, ranges: int, keys_of: Callable[[pa.Table], dict[int, tuple[np.ndarray, np.ndarray | None]]]) -> DataFrame:
    """One row per message: ``batch``, ``kind``, ``range``, ``keys``, ``values``. ``keys_of`` gives, per kind, sorted distinct keys and numbers that go with them."""

    def send(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for number, data in zip(batch.column("batch").to_pylist(), batch.column("data"), strict=True):
                rows = []
                for kind, (keys, values) in keys_of(unpack_table(data.as_py())).items():
                    for part, where in split_ranges(keys, ranges):
                        rows.append((number, kind, part, pack_sorted(keys[where]), None if values is None else pack_numbers(values[where])))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["batch", "kind", "range", "keys", "values"])

    return batches.mapInArrow(send, "batch long, kind int, range int, keys binary, values binary")


def answer(messages: DataFrame, merge: Callable[[int, np.ndarray, np.ndarray | None], tuple[np.ndarray, ...]]) -> DataFrame:
    """One row per message: ``batch``, ``kind``, ``range`` and packed ``answers``.

    For each kind and range, ``merge`` gets the keys of all messages with their values (the same key once per message) and gives
    one number for each. A task holds one range of one kind.
    """

    def reply(key, table):
        kind = key[0].as_py()
        asked = [unpack_sorted(x.as_py()) for x in table.column("keys")]
        values = None if table.column("values").null_count else np.concatenate([unpack_numbers(x.as_py()) for x in table.column("values")])
        numbers = merge(kind, np.concatenate(asked), values)
        cuts = np.cumsum([0, *map(len, asked)])
        packed = [pack_numbers(numbers[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"batch": table.column("batch"), "kind": table.column("kind"), "range": table.column("range"), "answers": pa.array(packed, pa.binary())})

    return messages.groupBy("kind", "range").applyInArrow(reply, "batch long, kind int, range int, answers binary")


def answers_of(table: pa.Table, kind: int) -> np.ndarray:
    """All answers of one kind in the order of the batch's sorted keys."""
    rows = sorted((r, a) for k, r, a in zip(*(table.column(c).to_pylist() for c in ("kind", "range", "answers")), strict=True) if k == kind)
    return np.concatenate([unpack_numbers(a) for _, a in rows]) if rows else np.zeros(0, np.uint64)
