"""Plant known leaks in a caller's own split, to measure what a detector recalls."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from leakscan.errors import InputError
from leakscan.functions import keys
from leakscan.functions.hashing import order_key
from leakscan.scratch import materialize
from leakscan.settings import DEFAULT_SEED, NEAR_OFFSET
from leakscan.sources.pair import SplitPair


@dataclass(frozen=True)
class Planted:
    """``pair`` with leaks in its test side, and the truth: ``test_id, source_id, kind``."""

    pair: SplitPair
    truth: DataFrame


def _fresh(prefix: str, name: str, dtype: T.DataType, turn: Column, highest: object) -> Column:
    """A value no row has yet: text gets a prefix, integers continue above the highest one."""
    if isinstance(dtype, T.StringType):
        return F.concat(F.lit(prefix), turn.cast("string"))
    if isinstance(dtype, keys.INTEGRAL):
        return (F.lit(int(highest or 0)).cast("bigint") + turn).cast(dtype)
    raise ValueError(f"column {name} must hold text or integers to receive planted values")


def _lowest(rows: DataFrame, ident: Column, seed: int, n: int) -> DataFrame:
    """The ``n`` rows whose ids hash lowest, numbered from 1 in that order."""
    picked = rows.withColumn("_key", order_key(seed, ident)).orderBy("_key", ident).limit(n)
    # ``picked`` holds the ``n`` rows asked for, so one window task numbers them.
    return picked.withColumn("_turn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_key", ident)))


def plant_leaks(
    pair: SplitPair,
    id_column: str,
    features: Sequence[str],
    group: str,
    n_exact: int,
    n_near: int,
    n_groups: int = 0,
    offset: float = NEAR_OFFSET,
    seed: int = DEFAULT_SEED,
    prefix: str = "planted-",
) -> Planted:
    """Append copies of train rows to test, and give test rows group ids of train.

    The ``n_exact`` train rows that hash lowest are copied unchanged, the next ``n_near``
    with ``offset`` on every numeric feature. Copies get new ids and new group ids, so
    they are no group leaks. The ``n_groups`` test rows that hash lowest are repeated
    with new ids under the group ids of the train rows of the same rank; as features they
    are test rows, so only the group is new.
    """
    schema = pair.train.schema
    ident, owner = F.col(f"`{id_column}`"), F.col(f"`{group}`")
    numeric = [name for name in features if keys.is_numeric(schema[name].dataType)]
    if n_near and not numeric:
        raise ValueError("near copies need a numeric feature")
    tops = pair.tagged(lambda _: [ident.alias("_i"), owner.alias("_g")]).agg(
        F.max("_i").alias("i"), F.max("_g").alias("g")
    ).first()
    before = pair.tagged(lambda _: [ident.cast("string").alias("_i"), owner.cast("string").alias("_g")]).where(
        F.col("_i").startswith(prefix) | F.col("_g").startswith(prefix)
    ).count()
    prefix = f"{prefix}{before}-" if before else prefix  # ids of an earlier call are not given again

    def fresh(column: str, highest: object, turn: Column) -> Column:
        return _fresh(prefix, column, schema[column].dataType, turn, highest)

    wide = {name: F.col(f"`{name}`").cast("double") for name in numeric}
    train, test = pair.train.withColumns(wide), pair.test.withColumns(wide)
    copies = _lowest(train, ident, seed, n_exact + n_near)
    near = F.col("_turn") > n_exact
    moved = {name: F.col(f"`{name}`") + F.when(near, F.lit(offset)).otherwise(0.0) for name in numeric}
    copies = copies.withColumns({**moved, "source_id": ident, "kind": F.when(near, "near").otherwise("exact")})
    copies = copies.withColumns({
        id_column: fresh(id_column, tops["i"], F.col("_turn")),
        group: fresh(group, tops["g"], F.col("_turn")),
    })
    planted = copies.select(*pair.train.columns, "source_id", "kind")
    if n_groups:
        donors = _lowest(
            train.where(~keys.missing(group, schema[group].dataType)).select(ident, owner), ident, seed, n_groups
        ).select("_turn", ident.alias("source_id"), owner.alias("_donor"))
        hosts = _lowest(test, ident, seed, n_groups).join(donors, "_turn").withColumns({
            group: F.col("_donor"),
            id_column: fresh(id_column, tops["i"], F.col("_turn") + n_exact + n_near),
            "kind": F.lit("group"),
        })
        planted = planted.unionByName(hosts.select(*pair.train.columns, "source_id", "kind"))
    planted = materialize(planted, "planted")
    asked, there = n_exact + n_near + n_groups, planted.count()
    if there < asked:
        raise InputError(f"only {there} of {asked} leaks can be planted: the sides have too few rows")
    truth = planted.select(ident.alias("test_id"), "source_id", "kind")
    return Planted(SplitPair(train, test.unionByName(planted.select(*pair.test.columns))), truth)


def recall(truth: DataFrame, row_matches: DataFrame) -> DataFrame:
    """Per planted kind of copy: planted rows, rows found, rows found with that kind."""
    found = row_matches.select("test_id", F.col("kind").alias("_found"))
    return (
        truth.where(F.col("kind") != "group")
        .join(found, "test_id", "left")
        .groupBy("kind")
        .agg(
            F.count(F.lit(1)).alias("planted"),
            F.count("_found").alias("found"),
            F.count_if(F.col("_found") == F.col("kind")).alias("found_as_planted"),
        )
    )
