"""Seeded order keys and row digests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

LANE_DIGITS = 15
LANES = 2


def order_key(seed: int, column: Column) -> Column:
    """MD5 of seed and id: a fixed pseudo-random order that any engine can reproduce."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), column.cast("string")))


def _field_text(field: T.StructField) -> Column:
    """One field as text that says where it ends. Numbers and dates hold no separator; texts carry their length."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.MapType):
        raise ValueError(f"column {field.name} has no stable text form")
    if isinstance(field.dataType, T.BinaryType):
        text = F.hex(column)
    elif isinstance(field.dataType, T.VariantType):
        text = F.to_json(column)
    elif isinstance(field.dataType, (T.ArrayType, T.StructType)):
        text = F.when(column.isNotNull(), F.to_json(F.struct(column), {"timeZone": "UTC"}))
    elif isinstance(field.dataType, T.TimestampType):
        return F.coalesce(F.unix_micros(column).cast("string"), F.lit("N"))
    elif isinstance(field.dataType, T.StringType):
        text = column
    else:
        return F.coalesce(column.cast("string"), F.lit("N"))
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("N"))


def row_digest(schema: T.StructType) -> Column:
    """SHA-256 over all fields; null, field borders and NUL bytes stay distinct."""
    return F.sha2(F.concat_ws(";", *map(_field_text, schema.fields)), 256)


def content_id(schema: T.StructType) -> Column:
    """A 124-bit number for the content of a row, cheap enough to compute and compare on every row.

    Two 64-bit hashes that start from different seeds, 62 bits of each. Nulls take part as flags.
    """
    parts = []
    for field in schema.fields:
        column = F.col(f"`{field.name}`")
        parts += [column, column.isNull()]
    kept = F.lit((1 << 62) - 1)
    high, low = (F.xxhash64(F.lit(seed), *parts).bitwiseAND(kept).cast("decimal(19,0)") for seed in (1, 2))
    return (high * F.lit(1 << 62).cast("decimal(19,0)") + low).cast("decimal(38,0)")


def digest_lanes(digest: Column) -> list[Column]:
    """The first 30 hex digits of a digest as two decimals that can be added without overflow."""
    return [
        F.conv(F.substring(digest, 1 + LANE_DIGITS * lane, LANE_DIGITS), 16, 10).cast("decimal(20,0)")
        for lane in range(LANES)
    ]
