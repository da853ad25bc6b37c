"""Small helpers that several operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leakscan.operators.lookup import lookup_join
from leakscan.scratch import materialize
from leakscan.settings import BROADCAST_ROWS

#: What separates words: space and the control characters 0x09 to 0x0D.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The maximal runs of characters that are no separators. Null stays null."""
    return F.filter(F.split(text, SEPARATOR_RUN, -1), lambda word: word != "")


def null_safe(column: Column) -> Column:
    """A string that is never null and differs between null and every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("~"))


def packed_row(df: DataFrame, **extra: Column) -> DataFrame:
    """All columns of ``df`` as the struct ``row`` beside new columns, so that no names can clash."""
    return df.select(F.struct(*[df[f"`{name}`"] for name in df.columns]).alias("row"), *[c.alias(n) for n, c in extra.items()])


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, how: str = "left") -> DataFrame:
    """Join ``table``, which has one row per key and is written already, to ``rows``.

    It is counted first: up to BROADCAST_ROWS rows it is broadcast. Beyond that both sides
    are shuffled and keys that hold a large share of the rows (``weight`` counts them) are salted.
    """
    size = table.agg(F.count("*"), F.sum(weight)).first()
    if size[0] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), list(keys), how)
    return lookup_join(rows, table, keys, how, weight, size[1], 0)


def among(rows: DataFrame, column: str, ids: DataFrame, wanted: bool = True) -> DataFrame:
    """``rows`` whose number in ``column`` is, or if not ``wanted`` is not, in the only column of ``ids``. Rows are not shuffled.

    A bit per number travels instead: 64 words for each block of 4096 numbers. The blocks are counted: up to BROADCAST_ROWS
    of them, which stand for 400 million dense numbers, are broadcast; beyond that both sides are shuffled.
    """
    name = ids.columns[0]
    words = ids.groupBy(F.expr(f"shiftright(`{name}`, 12)").alias("_block"), F.expr(f"shiftright(`{name}`, 6) & 63").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(`{name}` & 63 AS int))")).alias("bits"))
    blocks = words.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_bits"))
    blocks = materialize(blocks, "marks")
    if blocks.count() > BROADCAST_ROWS:
        same = rows.withColumnRenamed(column, "_number").join(ids.select(F.col(name).alias("_number")), "_number", "left_semi" if wanted else "left_anti")
        return same.withColumnRenamed("_number", column).select(*rows.columns)
    found = rows.withColumn("_block", F.expr(f"shiftright(`{column}`, 12)")).join(F.broadcast(blocks), "_block", "left")
    bits = F.coalesce(F.try_element_at("_bits", F.expr(f"shiftright(`{column}`, 6) & 63")), F.lit(0).cast("long"))
    marked = F.call_function("getbit", bits, F.expr(f"CAST(`{column}` & 63 AS int)")) == 1
    return found.where(marked if wanted else ~F.coalesce(marked, F.lit(False))).select(*rows.columns)


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal ``keys`` (numbers) in batches that are sorted by them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        changed = np.zeros(table.num_rows - 1, bool)
        for key in keys:
            values = table.column(key).to_numpy()
            changed |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist()]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            yield table.slice(start, stop - start)
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def per_process(kind: str, path: str, make: Callable[[str], object]) -> object:
    """``make(path)``, kept for later tasks of the same Python worker; it must bound what it remembers.

    Functions travel to workers by value, so a variable of a module would begin anew with each task.
    """
    kept = sys.__dict__.setdefault("leakscan_kept", {})
    if (kind, path) not in kept:
        kept[kind, path] = make(path)
    return kept[kind, path]


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["among", "attach", "grouped", "let", "materialize", "null_safe", "packed_row", "partitions", "per_process", "words", "SEPARATORS", "SEPARATOR_RUN"]
