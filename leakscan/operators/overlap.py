"""Entities that appear on both sides of a split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from leakscan.functions import keys
from leakscan.operators.lookup import lookup_join
from leakscan.scratch import materialize
from leakscan.settings import PREVIEW_SIZE, SALT_MIN_ROWS
from leakscan.sources.pair import TRAIN, SplitPair

OVERLAP_SCHEMA = "label string, n_train bigint, n_test bigint"


def _as_mixed(pair: SplitPair, group: str) -> bool:
    return any(keys.is_mixed(dtype) for dtype in pair.types(group))


def shared_ids(pair: SplitPair, group: str) -> DataFrame:
    """``group_id, n_train, n_test`` for every id on both sides.

    One shuffle of per-id counts that were already combined on the map side, so a very
    frequent id costs no more than a rare one. Missing ids are no ids.
    """
    left, right = pair.types(group)
    if not keys.comparable(left, right):
        side = left
        return pair.train.limit(0).select(
            keys.group_key(group, side).alias("group_id"),
            F.lit(0).cast("bigint").alias("n_train"),
            F.lit(0).cast("bigint").alias("n_test"),
        )
    mixed = _as_mixed(pair, group)

    def columns(schema: T.StructType):
        dtype = schema[group].dataType
        value = keys.group_key(group, dtype, mixed)
        return [F.when(~keys.missing(group, dtype), value).alias("group_id")]

    return (
        pair.tagged(columns)
        .where(F.col("group_id").isNotNull())
        .groupBy("group_id")
        .agg(F.count_if(F.col(TRAIN)).alias("n_train"), F.count_if(~F.col(TRAIN)).alias("n_test"))
        .where((F.col("n_train") > 0) & (F.col("n_test") > 0))
    )


def group_overlap(pair: SplitPair, group: str) -> DataFrame:
    """``label, n_train, n_test`` per shared id. Order by ``label`` where order matters."""
    ids = shared_ids(pair, group)
    return ids.select(
        keys.group_label(F.col("group_id"), ids.schema["group_id"].dataType).alias("label"), "n_train", "n_test"
    )


def shared_ids_of_splits(table: DataFrame, sides: Sequence[Column], group: str) -> DataFrame:
    """``group_id`` and, for split i, ``n_train_<i>, n_test_<i>``, for several splits of one table in one scan and one shuffle.

    Each of ``sides`` is true for a train row, false for a test row and null for a row of neither side.
    """
    dtype = table.schema[group].dataType
    rows = table.select(
        F.when(~keys.missing(group, dtype), keys.group_key(group, dtype)).alias("group_id"), *[side.alias(f"_s{i}") for i, side in enumerate(sides)]
    ).where(F.col("group_id").isNotNull())
    counts = [(F.count_if(F.col(f"_s{i}")).alias(f"n_train_{i}"), F.count_if(~F.col(f"_s{i}")).alias(f"n_test_{i}")) for i in range(len(sides))]
    shared = [f"(n_train_{i} > 0 AND n_test_{i} > 0)" for i in range(len(sides))]
    return rows.groupBy("group_id").agg(*[column for both in counts for column in both]).where(" OR ".join(shared))


def overlap_of_split(ids: DataFrame, number: int) -> DataFrame:
    """What ``group_overlap`` gives for one of the splits."""
    both = (F.col(f"n_train_{number}") > 0) & (F.col(f"n_test_{number}") > 0)
    label = keys.group_label(F.col("group_id"), ids.schema["group_id"].dataType)
    return ids.where(both).select(label.alias("label"), F.col(f"n_train_{number}").alias("n_train"), F.col(f"n_test_{number}").alias("n_test"))


def ordered_groups(overlap: DataFrame) -> DataFrame:
    """Shared ids in code-point order of their labels."""
    return overlap.orderBy("label")


def group_preview(overlap: DataFrame, size: int = PREVIEW_SIZE) -> DataFrame:
    """The first labels in code-point order, each with the number of labels not shown."""
    total = overlap.agg(F.count(F.lit(1))).scalar()
    return overlap.orderBy("label").limit(size).select(
        "label", F.greatest(total - F.lit(size), F.lit(0)).cast("bigint").alias("n_more")
    )


def rows_in_overlap(pair: SplitPair, group: str, side: str = "test", salt_min_rows: int = SALT_MIN_ROWS) -> DataFrame:
    """Rows of one side whose id is on both sides."""
    if side not in ("train", "test"):
        raise ValueError(f"unknown side: {side}")
    rows = pair.train if side == "train" else pair.test
    ids = materialize(shared_ids(pair, group).select("group_id", F.col(f"n_{side}").alias("_n")), "shared_ids")
    dtype = rows.schema[group].dataType
    value = keys.group_key(group, dtype, _as_mixed(pair, group))
    keyed = rows.withColumn("group_id", F.when(~keys.missing(group, dtype), value))
    total = ids.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return lookup_join(keyed, ids, ["group_id"], "left_semi", "_n", total, salt_min_rows).drop("group_id")
