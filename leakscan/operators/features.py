"""Which columns are compared, and how: decided from the two schemas alone."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from enum import Enum

from pyspark.sql import types as T

from leakscan.errors import InputError
from leakscan.functions import keys
from leakscan.sources.pair import SplitPair


class Kind(Enum):
    """How a column can be used. Truth values are compared by equality, but can stand in for numbers."""

    NUMBER = "numeric"
    TRUTH = "boolean"
    OTHER = "categorical"

    @classmethod
    def of(cls, dtype: T.DataType) -> Kind:
        if isinstance(dtype, T.BooleanType):
            return cls.TRUTH
        return cls.NUMBER if keys.is_numeric(dtype) else cls.OTHER


def presence_differences(pair: SplitPair, columns: Iterable[str]) -> dict[str, list[str]]:
    """Columns that only one side has, by what is wrong with them, in the order of their side."""
    wanted = set(columns)
    only = lambda side, other: [c for c in side.columns if c in wanted and c not in other.columns]
    found = {"missing from test": only(pair.train, pair.test), "extra in test": only(pair.test, pair.train)}
    return {problem: names for problem, names in found.items() if names}


def resolve_features(
    pair: SplitPair,
    features: str | Sequence[str] | None = None,
    group: str | None = None,
    target: str | None = None,
) -> list[str]:
    """The named features, or else every column but group and target, which both sides must then share."""
    if features:
        listed = features.split(",") if isinstance(features, str) else features
        names = [found.group() for found in (re.search(r"\S(?:.*\S)?", name) for name in listed) if found]
        if not names:
            raise InputError("the feature list does not name any column")
        return names
    everything = {*pair.train.columns, *pair.test.columns}
    if target and target not in everything:
        raise InputError(f"target column not in either table: {target}")
    candidates = everything - {group, target}
    if differences := presence_differences(pair, candidates):
        told = "; ".join(f"{problem}: {', '.join(names)}" for problem, names in differences.items())
        raise InputError(f"feature columns of train and test differ ({told})")
    if not candidates:
        raise InputError("no feature columns remain once group and target are set aside")
    return sorted(candidates, key=pair.train.columns.index)


def column_kinds(schema: T.StructType, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric features are compared by distance, all others by equality. Boolean is not numeric."""
    numeric = [name for name in features if Kind.of(schema[name].dataType) is Kind.NUMBER]
    return numeric, [name for name in features if name not in set(numeric)]


def require_same_kinds(schema: T.StructType, numeric: Sequence[str], categorical: Sequence[str]) -> None:
    """Test columns, given by their schema, must be usable the way the train columns are. All misfits are named."""
    used = {**dict.fromkeys(numeric, "numeric"), **dict.fromkeys(categorical, "non-numeric")}
    misfit = {"numeric": Kind.OTHER, "non-numeric": Kind.NUMBER}
    opposite = {"numeric": "non-numeric", "non-numeric": "numeric"}
    wrong = [f"{c}: {use} in train, {opposite[use]} in test" for c, use in used.items() if Kind.of(schema[c].dataType) is misfit[use]]
    if wrong:
        raise InputError("; ".join(wrong))
