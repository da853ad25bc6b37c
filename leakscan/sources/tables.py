"""Pairs from files, vector columns as features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from leakscan.errors import InputError
from leakscan.settings import MISSING_TOKENS
from leakscan.sources.literals import as_typed
from leakscan.sources.pair import SplitPair


def read_pair(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    missing_tokens: Sequence[str] = MISSING_TOKENS,
    row_ids: str | None = None,
    **options: object,
) -> SplitPair:
    """Read both sides with any Spark source; CSV has a header row and types found by ``literals``.

    In CSV, an empty field and each of ``missing_tokens`` count as missing. Without ``schema`` all fields are read as text and types
    are found in one more pass over both sides, so that a column has one type; pass a schema for large input. A column of mixed
    types is read as such from JSON by a schema that makes it ``variant``.

    ``row_ids`` names a new column ``struct<file:string,row:bigint>`` that holds the place of each row, for tables without an id.
    Only Parquet numbers its rows.
    """

    def load(path: str) -> DataFrame:
        reader = spark.read.format(fmt).options(**options)
        if fmt == "csv":
            reader = spark.read.format(fmt).option("header", True).options(**options)
        table = (reader if schema is None else reader.schema(schema)).load(path)
        if row_ids is not None:
            table = _with_places(table, row_ids, fmt)
        return _without_tokens(table, missing_tokens) if fmt == "csv" else table

    sides = load(train_path), load(test_path)
    texts = all(isinstance(f.dataType, T.StringType) for side in sides for f in side.schema.fields)
    return SplitPair(*(as_typed(sides) if fmt == "csv" and schema is None and texts else sides))


def _with_places(table: DataFrame, name: str, fmt: str) -> DataFrame:
    if fmt != "parquet":
        raise InputError(f"row ids need parquet files, not {fmt}")
    if name in table.columns:
        raise InputError(f"there is a column {name} already")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return table.select("*", place.alias(name))


def _without_tokens(table: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Null instead of a token in columns of text. Other columns have no value that a token could be read as but NaN."""
    texts = {f.name: F.col(f"`{f.name}`") for f in table.schema.fields if isinstance(f.dataType, T.StringType)}
    return table.withColumns({name: F.when(~column.isin(*tokens), column) for name, column in texts.items()}) if tokens else table


def expand_vectors(df: DataFrame, column: str, size: int, prefix: str | None = None) -> DataFrame:
    """Replace an array column by one double column per element; other lengths are an error."""
    prefix = column if prefix is None else prefix
    vector = F.col(f"`{column}`")
    checked = F.when(F.size(vector) == size, vector).when(
        vector.isNotNull(), F.raise_error(F.lit(f"{column} must have {size} elements"))
    )
    kept = [f"`{name}`" for name in df.columns if name != column]
    return df.withColumn(column, checked).selectExpr(
        *kept, *[f"CAST(`{column}`[{i}] AS double) AS `{prefix}_{i}`" for i in range(size)]
    )
