"""Which rows break the rules on missing and infinite features, row by row and as bounded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from leakscan.errors import InputError
from leakscan.functions import keys
from leakscan.functions.hashing import order_key
from leakscan.operators.features import column_kinds
from leakscan.settings import DEFAULT_SEED
from leakscan.sources.pair import TRAIN, SplitPair

SAMPLE = 10
MISSING, NONFINITE = "missing", "nonfinite"


def rule_violations(pair: SplitPair, features: Sequence[str], id_columns: Sequence[str]) -> DataFrame:
    """``side``, the id columns, ``column`` and ``rule``: one row for each feature of a row that is missing or infinite.

    These are the rows that stop an audit, so they can be written aside and left out of the pair. One scan, no shuffle.
    """
    ids = list(id_columns)
    clash = {"side", "column", "rule"} & set(ids)
    if not ids or clash:
        raise InputError(f"id column can't be named {clash.pop()}" if clash else "name at least one id column")
    for name in [*features, *ids]:
        if name not in pair.train.columns or name not in pair.test.columns:
            raise InputError(f"column not in both tables: {name}")
    numeric, _ = column_kinds(pair.train.schema, features)

    def columns(schema):
        broken = []
        for name in features:
            dtype = schema[name].dataType
            broken.append((name, MISSING, keys.missing(name, dtype)))
            if name in numeric and keys.is_numeric(dtype):
                broken.append((name, NONFINITE, F.expr(keys.nonfinite_sql(name))))
        found = [F.when(test, F.struct(F.lit(name).alias("column"), F.lit(rule).alias("rule"))) for name, rule, test in broken]
        return [*[F.col(f"`{name}`") for name in ids], F.array_compact(F.array(*found)).alias("_broken")]

    rows = pair.tagged(columns).where(F.size("_broken") > 0)
    return rows.select(F.when(F.col(TRAIN), "train").otherwise("test").alias("side"), *[f"`{name}`" for name in ids], F.inline("_broken"))


def violation_samples(violations: DataFrame, id_columns: Sequence[str], size: int = SAMPLE, seed: int = DEFAULT_SEED) -> DataFrame:
    """Per ``side``, ``column`` and ``rule``: ``n_rows`` and ``sample``, the ids of up to ``size`` rows with the smallest hashes.

    The sample depends on seed and ids alone. Each task passes on at most ``size`` rows per column and rule, so a column
    that is missing everywhere costs no more than another.
    """
    what = ["side", "column", "rule"]
    ids = F.concat_ws("|", *[F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) for name in id_columns])
    hashed = violations.select(*what, ids.alias("id"), order_key(seed, ids).alias("_order"))
    place = Window.partitionBy(*what).orderBy("_order", "id")
    few = hashed.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= size)
    samples = few.groupBy(*what).agg(F.array_sort(F.collect_list(F.struct("_place", "id"))).alias("_s"))
    counts = violations.groupBy(*what).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(samples, what).select(*what, "n_rows", F.transform("_s", lambda s: s["id"]).alias("sample"))
