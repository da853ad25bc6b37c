"""Matches in several splits of one table, from one scan, one shuffle and one near search.

A distinct feature vector carries, for each split, how many train and test rows have it and their lowest ids. Two bit masks follow:
the splits in which the vector is on the train side, and those in which it is on the test side and still lacks a match.
Two vectors are compared once if the masks have a split in common; the nearest train vector is then kept per split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from leakscan.errors import InputError
from leakscan.functions import hashing
from leakscan.operators.match import (
    Matches, SearchLimits, _cell_counts, _choose_grid, _chunk_table, _chunked, _Grid, _measured, _pairs, _parts, _search, _vector_columns, classify, lowest_id, numbered, row_id,
)
from leakscan.operators.validate import EMPTY, CheckedInput
from leakscan.scratch import discard, materialize
from leakscan.sources.pair import SplitPair

#: Bits of a mask.
MOST_SPLITS = 62


def find_matches_of_splits(
    table: DataFrame,
    sides: Sequence[Column],
    numeric: Sequence[str],
    categorical: Sequence[str],
    near_atol: float,
    exact_atol: float,
    id_columns: Sequence[str] = (),
    limits: SearchLimits = SearchLimits(),
) -> list[Matches]:
    """What ``find_matches`` gives for each split. Each of ``sides`` is true for a train row, false for a test row, null for neither.

    Raises ``InputError`` if a side of any split is empty, and for missing and infinite values.
    """
    if not 0 < len(sides) <= MOST_SPLITS:
        raise InputError(f"name 1 to {MOST_SPLITS} splits")
    numbers = range(len(sides))
    features = _vector_columns(SplitPair(table, table), numeric, categorical, table.schema)
    ids = [row_id(id_columns).alias("_id")] if id_columns else []
    rows = table.select(*features, *ids, *[side.alias(f"_s{i}") for i, side in enumerate(sides)])
    rows = rows.where(" OR ".join(f"_s{i} IS NOT NULL" for i in numbers))
    vector = [name for name in rows.columns if not name.startswith(("_s", "_id"))]
    vectors = materialize(numbered(_collapsed(rows, vector, len(sides), bool(id_columns))), "vectors")
    checked = _check(vectors, vector, numeric, categorical, len(sides))

    copies = [_of_split(vectors, vector, i).where((F.col("n_train") > 0) & (F.col("n_test") > 0)).drop("n_train", "_row") for i in numbers]
    if numeric:
        found = [copy.withColumn("distance", F.lit(0.0)) for copy in copies]
        if near_atol > 0:
            near = _near(vectors, vector, [checked[0].largest[name] for name in numeric], near_atol, limits, len(sides))
            for i in numbers:
                for level in near[i]:
                    found[i] = found[i].unionByName(level)
        found = [f.withColumn("kind", classify(F.col("distance"), exact_atol)) for f in found]
    else:
        found = [copy.withColumns({"distance": F.lit(None).cast("double"), "kind": F.lit("exact")}) for copy in copies]
    of_side = [rows.where(~F.col(f"_s{i}")).select(*vector, *(["_id"] if id_columns else [])).withColumnRenamed("_id", "test_id") for i in numbers]
    return [Matches(checked[i], found[i], tuple(vector), of_side[i], limits.salt_min_rows) for i in numbers]


def _collapsed(rows: DataFrame, vector: Sequence[str], splits: int, with_ids: bool) -> DataFrame:
    sums = {}
    for i in range(splits):
        train = F.col(f"_s{i}")
        sums |= {f"n_train_{i}": F.count_if(train), f"n_test_{i}": F.count_if(~train)}
        if with_ids:
            sums |= {f"train_id_{i}": F.min(F.when(train, F.col("_id"))), f"test_id_{i}": F.min(F.when(~train, F.col("_id")))}
    found = rows.groupBy(*vector).agg(*[value.alias(name) for name, value in sums.items()])
    if with_ids:
        return found
    content = hashing.content_id(found.select(*vector).schema)
    named = found.withColumn("_content", content)
    return named.withColumns({
        f"{side}_id_{i}": F.when(F.col(f"n_{side}_{i}") > 0, F.col("_content")) for i in range(splits) for side in ("train", "test")
    }).drop("_content")


def _check(vectors: DataFrame, vector: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], splits: int) -> list[CheckedInput]:
    """Sizes of all sides and the checks of values, in one aggregate over the distinct vectors."""
    values = [name for name in vector if name.startswith("_n")]
    lost = " OR ".join([f"{name} IS NULL" for name in vector] + [f"isnan({name})" for name in values])
    wild = " OR ".join(["false", *[f"abs({name}) = CAST('Infinity' AS double)" for name in values]])
    row = vectors.agg(
        *[F.coalesce(F.sum(f"n_{side}_{i}"), F.lit(0)).alias(f"n_{side}_{i}") for i in range(splits) for side in ("train", "test")],
        F.expr(f"count_if({lost}) AS lost"), F.expr(f"count_if({wild}) AS wild"), *[F.expr(f"max(abs({name})) AS {name}") for name in values],
    ).first()
    if not all(row[f"n_{side}_{i}"] for i in range(splits) for side in ("train", "test")):
        raise InputError(EMPTY)
    if row["lost"]:
        raise InputError("feature columns contain missing values")
    if row["wild"]:
        raise InputError("numeric feature columns may hold finite values only")
    largest = {name: row[f"_n{i}"] or 0.0 for i, name in enumerate(numeric)}
    return [CheckedInput(row[f"n_train_{i}"], row[f"n_test_{i}"], tuple(numeric), tuple(categorical), largest) for i in range(splits)]


def _of_split(vectors: DataFrame, vector: Sequence[str], number: int) -> DataFrame:
    """Vectors of either side of one split, as ``find_matches`` has them."""
    own = [F.col(f"{name}_{number}").alias(name) for name in ("train_id", "test_id", "n_train", "n_test")]
    return vectors.select(*vector, *own, "_row").where((F.col("n_train") > 0) | (F.col("n_test") > 0))


def _mask(conditions: Sequence[Column]) -> Column:
    mask = F.lit(0).cast("long")
    for i, condition in enumerate(conditions):
        mask = mask + F.when(condition, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return mask


def _near(
    vectors: DataFrame, vector: Sequence[str], largest: Sequence[float], near_atol: float, limits: SearchLimits, splits: int
) -> list[list[DataFrame]]:
    """Per split the tables of settled test vectors.

    One search serves all splits if its measured work at the asked radius is within the budget; else each split is searched through
    narrower radii first, from the same collapsed vectors.
    """
    numbers = range(splits)
    categories = [name for name in vector if not name.startswith("_n")]
    has = _mask([F.col(f"n_train_{i}") > 0 for i in numbers])
    wants = _mask([(F.col(f"n_test_{i}") > 0) & (F.col(f"n_train_{i}") == 0) for i in numbers])
    train = vectors.select(*vector, has.alias("_has"), *[f"train_id_{i}" for i in numbers]).where("_has > 0")
    test = vectors.select(*vector, wants.alias("_wants"), *[f"{name}_{i}" for i in numbers for name in ("test_id", "n_test")]).where("_wants > 0")

    n_train, n_test, cells = _choose_grid(train, test, largest, near_atol)
    if n_test == 0:
        return [[] for _ in numbers]
    budget = max(limits.min_pair_budget, limits.pairs_per_vector * (n_train + n_test))
    hot = 0
    if float(n_train) * n_test > min(budget, limits.chunk_rows**2):
        cells, work, hot = _measured(train, test, cells, categories, budget, limits)
        if work > budget:
            return [_search(_of_split(vectors, vector, i), vector, largest, near_atol, limits) for i in numbers]
    chunks = _chunk_table(_cell_counts(train, test, cells, categories), limits.chunk_rows) if hot else None
    hinted = F.broadcast(chunks) if hot and hot <= limits.broadcast_rows else chunks
    parts = _parts(vectors, work, limits) if hot else 0
    level = materialize(_nearest_of_splits(train, test, cells, categories, vector, splits, hinted, parts), "near")
    if chunks is not None:
        discard(chunks)
    return [[
        level.where(F.col(f"_best_{i}").isNotNull()).select(
            *vector, F.col(f"_best_{i}.train_id").alias("train_id"), F.col(f"test_id_{i}").alias("test_id"), F.col(f"n_test_{i}").alias("n_test"),
            F.col(f"_best_{i}.distance").alias("distance"),
        )
    ] for i in numbers]


def _nearest_of_splits(
    train: DataFrame, test: DataFrame, cells: _Grid, categories: Sequence[str], vector: Sequence[str], splits: int, chunks: DataFrame | None, parts: int = 0
) -> DataFrame:
    """Test vectors with their nearest train vector within the grid's radius, one struct ``_best_<i>`` per split.

    As in ``_nearest``, least distances come first and lowest train ids at them second, so that no pairs are sorted.
    """
    numbers = range(splits)
    known = [*vector, "_wants", *[f"{name}_{i}" for i in numbers for name in ("test_id", "n_test")]]
    least = (
        _pairs(train, test, cells, categories, vector, chunks, parts=parts)
        .where("(_has & _wants) <> 0")
        .groupBy(*known)
        .agg(*[F.min(F.expr(f"CASE WHEN (_has & _wants & {1 << i}) <> 0 THEN _distance END")).alias(f"_d{i}") for i in numbers])
        .withColumn("_reach", F.greatest(*[F.col(f"_d{i}") for i in numbers]) if splits > 1 else F.col("_d0"))
    )
    lowest = {i: f"(_has & _wants & {1 << i}) <> 0 AND _distance = _d{i}" for i in numbers}
    return (
        _pairs(train, least, cells, categories, vector, chunks, "_reach", parts)
        .where(" OR ".join(f"({test})" for test in lowest.values()))
        .groupBy(*known, *[f"_d{i}" for i in numbers])
        .agg(*[lowest_id(f"train_id_{i}", f"({test})").alias(f"_t{i}") for i, test in lowest.items()])
        .withColumns({
            f"_best_{i}": F.when(F.col(f"_d{i}").isNotNull(), F.struct(F.col(f"_d{i}").alias("distance"), F.col(f"_t{i}").alias("train_id"))) for i in numbers
        })
    )
