"""Input checks: schema checks on the driver, data checks in one aggregate over both sides."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from leakscan.errors import InputError
from leakscan.functions import keys
from leakscan.operators.features import column_kinds, require_same_kinds
from leakscan.settings import UNHASHABLE
from leakscan.sources.pair import TRAIN, SplitPair


EMPTY = "train and test need at least one row each"


@dataclass(frozen=True)
class CheckedInput:
    """What the checks learned about the two sides."""

    n_train: int
    n_test: int
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    largest: dict[str, float]


def input_profile(pair: SplitPair, features: Sequence[str]) -> DataFrame:
    """Per side: rows, rows with a missing feature, rows with an infinite one, largest absolute values.

    One pass and one map-side-combined aggregate for both sides. ``max_abs_<i>`` follows the
    order of the numeric features.
    """
    numeric, _ = column_kinds(pair.train.schema, features)

    def columns(schema):
        types = {name: schema[name].dataType for name in features}
        lost = [keys.missing_sql(name, types[name]) for name in features]
        wild = [keys.nonfinite_sql(name) for name in numeric if keys.is_numeric(types[name])]
        usable = {name for name in numeric if keys.is_numeric(types[name]) or keys.family(types[name]) == "bool"}
        sizes = [
            f"abs(CAST({f'`{name}`' if name in usable else 'NULL'} AS double)) AS _m{i}"
            for i, name in enumerate(numeric)
        ]
        return [
            F.expr(" OR ".join(["false", *lost])).alias("_missing"),
            F.expr(" OR ".join(["false", *wild])).alias("_nonfinite"),
            *map(F.expr, sizes),
        ]

    return (
        pair.tagged(columns)
        .groupBy(F.when(F.col(TRAIN), "train").otherwise("test").alias("side"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("_missing")).alias("rows_with_missing"),
            F.count_if(F.col("_nonfinite")).alias("rows_with_nonfinite"),
            *[F.expr(f"max(_m{i}) AS max_abs_{i}") for i in range(len(numeric))],
        )
    )


def check_tolerances(near_atol: float, exact_atol: float) -> None:
    if not (math.isfinite(near_atol) and math.isfinite(exact_atol)):
        raise InputError("both tolerances must be finite")
    if min(near_atol, exact_atol) < 0:
        raise InputError("both tolerances must be non-negative")
    if exact_atol > near_atol:
        raise InputError("exact_atol may not exceed near_atol")


def check_columns(pair: SplitPair, features: Sequence[str], group: str | None) -> None:
    shared = set(pair.train.columns) & set(pair.test.columns)
    for name in features:
        if name not in shared:
            raise InputError(f"feature column not in both tables: {name}")
    if group is not None and group not in shared:
        raise InputError(f"group column not in both tables: {group}")


def check_schema(
    pair: SplitPair, features: Sequence[str], group: str | None, near_atol: float, exact_atol: float
) -> tuple[list[str], list[str]]:
    """Numeric and categorical features, or ``InputError``. Reads data only to tell which error comes first."""
    try:
        if not features:
            raise InputError("name at least one feature column")
        check_tolerances(near_atol, exact_atol)
        check_columns(pair, features, group)
    except InputError:
        if pair.train.isEmpty() or pair.test.isEmpty():
            raise InputError(EMPTY) from None
        raise
    numeric, categorical = column_kinds(pair.train.schema, features)
    try:
        require_same_kinds(pair.test.schema, numeric, categorical)
        for name in categorical:
            if not all(keys.is_hashable(dtype) for dtype in pair.types(name)):
                raise InputError(UNHASHABLE)
    except InputError:
        check_profile(input_profile(pair, features), numeric, categorical, finite=False)
        raise
    return numeric, categorical


def check_profile(
    profile: DataFrame, numeric: Sequence[str], categorical: Sequence[str], finite: bool = True
) -> CheckedInput:
    """Raise ``InputError`` for empty sides, missing values and infinite values, in this order."""
    sides = {row["side"]: row for row in profile.collect() if row["n_rows"]}
    if set(sides) != {"train", "test"}:
        raise InputError(EMPTY)
    if any(row["rows_with_missing"] for row in sides.values()):
        raise InputError("feature columns contain missing values")
    if finite and any(row["rows_with_nonfinite"] for row in sides.values()):
        raise InputError("numeric feature columns may hold finite values only")
    return CheckedInput(
        n_train=sides["train"]["n_rows"],
        n_test=sides["test"]["n_rows"],
        numeric=tuple(numeric),
        categorical=tuple(categorical),
        largest={
            name: max(row[f"max_abs_{i}"] or 0.0 for row in sides.values()) for i, name in enumerate(numeric)
        },
    )
