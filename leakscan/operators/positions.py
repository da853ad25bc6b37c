"""Places in a total order, without one task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from leakscan.errors import InputError
from leakscan.functions.hashing import content_id
from leakscan.scratch import materialize

_PLACE_BITS = 33  # the lower bits of monotonically_increasing_id count the rows of a partition


def with_position(rows: DataFrame, order: Sequence[str], into: str = "position", ranges: int | None = None) -> DataFrame:
    """``rows`` with their place, from 0, in the order of the columns ``order``; nulls first, ties by the content of the row.

    Rows are range-partitioned, sorted and written once, which freezes their places in a range. A place in the table adds
    the rows of the ranges before, one number per range. The written files are in order, one range each. Because content
    takes part in the partitioning, a value that many rows share is spread over ranges; only equal rows stay together.
    """
    clash = {into, "_tie", "_at", "_range", "_before"} & set(rows.columns)
    if clash:
        raise InputError(f"column name is taken: {min(clash)}")
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(f"`{name}`") for name in order], F.col("_tie")]
    tied = rows.withColumn("_tie", content_id(rows.schema))
    placed = tied.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    written = materialize(placed.drop("_tie"), "positions")
    here = F.shiftright("_at", _PLACE_BITS)
    # one row per range, so one window task and a broadcast are safe
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = written.groupBy(here.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + F.col("_before")
    joined = written.withColumn("_range", here).join(F.broadcast(before), "_range")
    return joined.select(place.alias(into), *[F.col(f"`{name}`") for name in rows.columns])
