"""Seeded splits with exact sizes, decided row by row from a cut-off.

Ids are ranked by MD5 of seed and id. Only the cut-off id per class is searched for; each
row then compares itself with the cut-off, so the rows themselves are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from leakscan.errors import InputError
from leakscan.functions.hashing import order_key
from leakscan.operators.lookup import lookup_join
from leakscan.scratch import discard, materialize
from leakscan.settings import BROADCAST_ROWS, DEFAULT_SEED, RANK_BUCKET_ROWS, SALT_MIN_ROWS, TEST_SHARE

DIGITS_PER_STEP = 3


def _check_share(share: float) -> None:
    if not 0 < share < 1:
        raise ValueError(f"the test share must lie between 0 and 1: {share}")


def _cutoffs(ranked: DataFrame, wanted: DataFrame, largest: int, n_classes: int, bucket_rows: int) -> DataFrame:
    """``_class, _cut_key, _cut_id``: the ``take``-th smallest (key, id) of each class.

    ``ranked``: ``_class, _key, _id``; ``wanted``: ``_class, take`` with ``take > 0``. Histograms over key
    prefixes narrow each class to one bucket of about ``bucket_rows`` ids, which a window then ranks.
    """
    digits, buckets = 0, []
    while largest / 16**digits > bucket_rows:
        narrowed = _inside(ranked, wanted, digits, n_classes)
        digits += DIGITS_PER_STEP
        upto = Window.partitionBy("_class").orderBy("_prefix")
        histogram = (
            narrowed.groupBy("_class", "take", F.substring("_key", 1, digits).alias("_prefix"))
            .count()
            .withColumn("_upto", F.sum("count").over(upto))
        )
        buckets.append(materialize(
            histogram.where((F.col("_upto") >= F.col("take")) & (F.col("_upto") - F.col("count") < F.col("take")))
            .select("_class", "_prefix", (F.col("take") - F.col("_upto") + F.col("count")).alias("take")),
            "cut_bucket",
        ))
        wanted = buckets[-1]
    place = Window.partitionBy("_class").orderBy("_key", "_id")
    found = materialize(
        _inside(ranked, wanted, digits, n_classes)
        .withColumn("_place", F.row_number().over(place))
        .where(F.col("_place") == F.col("take"))
        .select("_class", F.col("_key").alias("_cut_key"), F.col("_id").alias("_cut_id")),
        "cutoffs",
    )
    discard(*buckets)
    return found


def _inside(ranked: DataFrame, wanted: DataFrame, digits: int, n_classes: int) -> DataFrame:
    """Ids in the bucket that holds the cut-off of their class, with ``take`` counted from its start."""
    if n_classes <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    if digits == 0:
        return ranked.join(wanted, "_class")
    return ranked.withColumn("_prefix", F.substring("_key", 1, digits)).join(wanted, ["_class", "_prefix"])


def class_sizes(table: DataFrame, target: str, share: float = TEST_SHARE) -> DataFrame:
    """``_class, n, take``: test rows per class, floor of the share first, then largest remainders."""
    counts = table.groupBy(F.col(f"`{target}`").alias("_class")).count().withColumnRenamed("count", "n")
    # One row per class, so one window task holds them.
    everything = Window.partitionBy(F.lit(0))
    product = F.col("n").cast("decimal(18,0)") * F.col("_n_test")
    exact = (
        counts.withColumn("_n_rows", F.sum("n").over(everything))
        .withColumn("_n_test", F.ceil(F.col("_n_rows") * F.lit(share)).cast("decimal(18,0)"))
        .withColumn("_left", (product % F.col("_n_rows").cast("decimal(18,0)")).cast("decimal(38,0)"))
        .withColumn(
            "_base", ((product - F.col("_left")) / F.col("_n_rows").cast("decimal(18,0)")).cast("bigint")
        )
    )
    order = everything.orderBy(F.desc("_left"), F.col("_class").cast("string"))
    spare = F.col("_n_test").cast("bigint") - F.sum("_base").over(everything)
    return exact.withColumn("_turn", F.row_number().over(order)).select(
        "_class", "n", (F.col("_base") + F.when(F.col("_turn") <= spare, 1).otherwise(0)).alias("take")
    )


def stratified_row_split(
    table: DataFrame,
    id_column: str,
    target: str,
    seed: int = DEFAULT_SEED,
    share: float = TEST_SHARE,
    into: str = "split",
    bucket_rows: int = RANK_BUCKET_ROWS,
    salt_min_rows: int = SALT_MIN_ROWS,
) -> DataFrame:
    """Add ``split``: ``ceil(share * n)`` rows are ``test`` and classes keep their shares.

    ``id_column`` must be unique and ``target`` must not be null.
    """
    _check_share(share)
    label = F.col(f"`{target}`")
    ident = F.col(f"`{id_column}`")
    sizes = materialize(class_sizes(table, target, share), "class_sizes")
    stats = sizes.agg(
        F.max("n").alias("largest"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.count_if(F.col("_class").isNull()).alias("nulls")
    ).first()
    if stats["nulls"]:
        raise InputError(f"target column contains missing values: {target}")
    if not stats["total"]:
        raise InputError("the table has no rows to split")
    ranked = table.select(label.alias("_class"), order_key(seed, ident).alias("_key"), ident.alias("_id"))
    wanted = sizes.where(F.col("take") > 0).select("_class", "take")
    cuts = _cutoffs(ranked, wanted, stats["largest"], stats["k"], bucket_rows)
    cuts = sizes.join(cuts, "_class", "left").drop("take")
    if stats["k"] <= BROADCAST_ROWS:
        rows = table.withColumn("_class", label).join(F.broadcast(cuts), "_class", "left")
    else:
        rows = lookup_join(
            table.withColumn("_class", label), cuts, ["_class"], "left", "n", stats["total"], salt_min_rows
        )
    key = order_key(seed, ident)
    inside = (key < F.col("_cut_key")) | ((key == F.col("_cut_key")) & (ident <= F.col("_cut_id")))
    return rows.withColumn(into, F.when(inside, "test").otherwise("train")).select(*table.columns, into)


def group_split(
    table: DataFrame,
    group: str,
    seed: int = DEFAULT_SEED,
    share: float = TEST_SHARE,
    into: str = "split",
    bucket_rows: int = RANK_BUCKET_ROWS,
) -> DataFrame:
    """Add ``split``: ``ceil(share * groups)`` whole groups are ``test``. Ids must not be null."""
    _check_share(share)
    ident = F.col(f"`{group}`")
    groups = materialize(
        table.select(ident.alias("_id")).distinct().select(
            F.lit(0).alias("_class"), order_key(seed, F.col("_id")).alias("_key"), "_id"
        ),
        "groups",
    )
    stats = groups.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_id").isNull()).alias("nulls")).first()
    if stats["nulls"]:
        raise InputError(f"group column contains missing values: {group}")
    if not stats["n"]:
        raise InputError("the table has no rows to split")
    take = math.ceil(share * stats["n"])
    wanted = table.sparkSession.range(1).select(F.lit(0).alias("_class"), F.lit(take).cast("bigint").alias("take"))
    found = _cutoffs(groups, wanted, stats["n"], 1, bucket_rows)
    cut = found.first()
    discard(groups, found)
    key = order_key(seed, ident)
    inside = (key < F.lit(cut["_cut_key"])) | ((key == F.lit(cut["_cut_key"])) & (ident <= F.lit(cut["_cut_id"])))
    return table.withColumn(into, F.when(inside, "test").otherwise("train"))
