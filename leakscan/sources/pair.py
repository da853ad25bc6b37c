"""A train table and a test table, seen as one stream of tagged rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from leakscan.errors import InputError
from leakscan.functions.variants import typed_variants

TRAIN = "_train"


@dataclass(frozen=True)
class SplitPair:
    """Train and test rows.

    ``table`` and ``split_column`` are set when both sides come from one table; then
    every operator scans that table once instead of once per side. VARIANT columns
    become columns that mix types.
    """

    train: DataFrame
    test: DataFrame
    table: DataFrame | None = None
    split_column: str | None = None
    train_value: str = "train"
    test_value: str = "test"

    def __post_init__(self):
        for name in ("train", "test", "table"):
            if getattr(self, name) is not None:
                object.__setattr__(self, name, typed_variants(getattr(self, name)))

    def tagged(self, columns: Callable[[T.StructType], list[Column]]) -> DataFrame:
        """Rows of both sides with the columns that ``columns(schema)`` returns, plus boolean ``_train``."""
        if self.table is not None:
            side = F.col(f"`{self.split_column}`")
            return self.table.where(side.isin(self.train_value, self.test_value)).select(
                *columns(self.train.schema), (side == self.train_value).alias(TRAIN)
            )
        return self.train.select(*columns(self.train.schema), F.lit(True).alias(TRAIN)).unionByName(
            self.test.select(*columns(self.test.schema), F.lit(False).alias(TRAIN))
        )

    def types(self, name: str) -> tuple[T.DataType, T.DataType]:
        return self.train.schema[name].dataType, self.test.schema[name].dataType


def known_side(table: DataFrame, split_column: str, train_value: str, test_value: str, ignored_values: Sequence[str | None] = ()) -> Column:
    """The split column, which stops the job at a value that is neither a side nor ignored."""
    if split_column not in table.columns:
        raise InputError(f"split column not in table: {split_column}")
    side = F.col(f"`{split_column}`")
    known = F.coalesce(side.isin(train_value, test_value, *[v for v in ignored_values if v is not None]), F.lit(None in ignored_values))
    told = F.raise_error(F.concat(F.lit(f"unknown value in split column {split_column}: "), F.coalesce(side.cast("string"), F.lit("null"))))
    return F.when(known, side).otherwise(told)


def split_pair(
    table: DataFrame,
    split_column: str = "split",
    train_value: str = "train",
    test_value: str = "test",
    ignored_values: Sequence[str | None] = (),
) -> SplitPair:
    """The two sides of a table that carries a split column.

    Rows with any other split value stop the audit when they are read, unless the value (None for null) is ignored.
    """
    side = F.col(f"`{split_column}`")
    table = table.withColumn(split_column, known_side(table, split_column, train_value, test_value, ignored_values))
    return SplitPair(
        table.where(side == train_value).drop(split_column),
        table.where(side == test_value).drop(split_column),
        table,
        split_column,
        train_value,
        test_value,
    )
