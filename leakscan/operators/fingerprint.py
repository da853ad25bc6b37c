"""One short hash for a whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from leakscan.functions.hashing import LANES, digest_lanes, row_digest


def table_fingerprint(table: DataFrame) -> DataFrame:
    """``fingerprint``: 16 hex digits over column names, types, and the multiset of rows.

    Row digests are added lane by lane, so order and partitioning do not matter, repeated rows
    count, and one map-side-combined aggregate does the whole table without a shuffle of rows.
    """
    sums = table.agg(*fingerprint_sums(table.schema))
    text = F.concat_ws("|", F.lit(_header(table.schema)), *[F.col(name).cast("string") for name in sums.columns])
    return sums.select(F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def _header(schema: T.StructType) -> str:
    return ",".join(f"{field.name}:{field.dataType.simpleString()}" for field in schema.fields)


def fingerprint_sums(schema: T.StructType) -> list[Column]:
    """Row count and lane sums as aggregates, so that another job over the rows can observe them."""
    lanes = digest_lanes(row_digest(schema))
    totals = [F.coalesce(F.sum(lane.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"_l{i}") for i, lane in enumerate(lanes)]
    return [F.count(F.lit(1)).alias("_n"), *totals]


def fingerprint_of(schema: T.StructType, sums: Mapping[str, object]) -> str:
    """The fingerprint of a table whose ``fingerprint_sums`` are known."""
    parts = [_header(schema), *[f"{int(sums[name])}" for name in ("_n", *[f"_l{i}" for i in range(LANES)])]]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]
