"""Many-to-one join that stays balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from leakscan.settings import SALT_MIN_ROWS, SPREAD


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    weight: str | None = None,
    total: int | None = None,
    salt_min_rows: int = SALT_MIN_ROWS,
) -> DataFrame:
    """Join ``rows`` to ``table``, which has one row per key.

    ``weight`` names the column of ``table`` that counts the matching rows, ``total``
    their sum. Keys above ``total / spread`` are then salted, where spread is SPREAD or the number of shuffle partitions if
    that is more: fewer than ``spread`` keys qualify, so the table of hot keys is small enough to broadcast whatever the input
    size, and hot keys add fewer than ``2 * spread`` rows to ``table``. The salt is
    the scan partition of a row, which a retried task reproduces. Null keys match nothing.
    """
    if weight is None or total is None or total < salt_min_rows:
        return rows.join(table, list(keys), how)
    # as many parts as the join has tasks, so that no key holds more than its share of one
    spread = max(SPREAD, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = -(-total // spread)
    salts = F.ceil(F.col(weight) / F.lit(share)).cast("int")
    hot = table.where(F.col(weight) > share).select(*keys, salts.alias("_salts"))
    salted_rows = rows.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.spark_partition_id(), F.col("_salts"))),
    )
    salted_table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return salted_rows.drop("_salts").join(salted_table, [*keys, "_salt"], how).drop("_salt")
