"""Target encoding, scaling and the design matrix, each fitted on the rows the caller chooses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from leakscan.errors import InputError
from leakscan.operators.lookup import lookup_join
from leakscan.scratch import materialize
from leakscan.settings import ENCODING_SMOOTHING, SALT_MIN_ROWS

POPULATIONS = {"all": "all rows", "train": "train only"}


def fit_rows(table: DataFrame, population: str, split: str = "split") -> DataFrame:
    """The rows that encoder and scaler may see."""
    if population not in POPULATIONS:
        raise ValueError(f"fit population must be one of {sorted(POPULATIONS)}: {population}")
    return table if population == "all" else table.where(F.col(f"`{split}`") == "train")


def _code_columns(code: str) -> list[Column]:
    """Codes compare as text. A missing code is a category of its own, apart from every text."""
    text = F.col(f"`{code}`").cast("string")
    return [F.coalesce(text, F.lit("")).alias("_code"), text.isNull().alias("_no_code")]


def fit_target_encoding(
    rows: DataFrame, code: str, target: str, smoothing: float = ENCODING_SMOOTHING
) -> tuple[DataFrame, float]:
    """Per-code shrunk mean of the target as ``code, encoded, n``, and the overall mean."""
    label = F.col(f"`{target}`").cast("double")
    per_code = materialize(
        rows.select(*_code_columns(code), label.alias("_y"))
        .groupBy("_code", "_no_code")
        .agg(
            F.sum("_y").alias("_sum"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("_y").isNull() | F.isnan("_y")).alias("_missing"),
        ),
        "codes",
    )
    totals = per_code.agg(
        F.sum("_sum").alias("sum"), F.sum("n").alias("n"), F.sum("_missing").alias("missing")
    ).first()
    if totals["missing"]:
        raise InputError(f"target column contains missing values: {target}")
    if not totals["n"]:
        raise InputError("an encoding needs at least one row")
    mean = totals["sum"] / totals["n"]
    encoded = (F.col("_sum") + F.lit(smoothing * mean)) / (F.col("n") + F.lit(float(smoothing)))
    return per_code.select(
        F.when(~F.col("_no_code"), F.col("_code")).alias("code"), encoded.alias("encoded"), "n"
    ), mean


def apply_target_encoding(
    rows: DataFrame,
    encoding: DataFrame,
    mean: float,
    code: str,
    into: str = "encoded",
    n_rows: int | None = None,
    salt_min_rows: int = SALT_MIN_ROWS,
) -> DataFrame:
    """Add the encoded value; codes the encoder never saw get the overall mean.

    Frequent codes are salted by the encoder's own counts; ``n_rows`` is their sum if the caller knows it.
    """
    if n_rows is None:
        n_rows = encoding.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    text, absent = _code_columns("code")
    table = encoding.select(text, absent, F.col("encoded").alias("_encoded"), "n")
    keyed = rows.select(*[F.col(f"`{name}`") for name in rows.columns], *_code_columns(code))
    joined = lookup_join(keyed, table, ["_code", "_no_code"], "left", "n", n_rows, salt_min_rows)
    return joined.withColumn(into, F.coalesce("_encoded", F.lit(mean))).drop("_code", "_no_code", "_encoded", "n")


def fit_scaler(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, mean, std`` with the population standard deviation; a constant column gets 1."""
    both = rows.agg(*[
        F.struct(
            F.lit(name).alias("column"),
            F.avg(F.col(f"`{name}`").cast("double")).alias("mean"),
            F.stddev_pop(F.col(f"`{name}`").cast("double")).alias("std"),
        ).alias(f"_s{i}")
        for i, name in enumerate(columns)
    ])
    return both.select(F.inline(F.array(*[f"_s{i}" for i in range(len(columns))]))).withColumn(
        "std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    )


def apply_scaler(rows: DataFrame, scaler: DataFrame, suffix: str = "_scaled") -> DataFrame:
    """Add one standardised column per row of ``scaler``, which has one row per feature."""
    added = {
        f"{row['column']}{suffix}": (F.col(f"`{row['column']}`").cast("double") - F.lit(row["mean"]))
        / F.lit(row["std"])
        for row in scaler.collect()
    }
    return rows.withColumns(added)


def design_matrix(rows: DataFrame, columns: Sequence[str], into: str = "features") -> DataFrame:
    """The given columns as one vector, in the given order."""
    return VectorAssembler(inputCols=list(columns), outputCol=into, handleInvalid="error").transform(rows)
