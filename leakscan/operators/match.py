"""Test rows that copy a train row, exactly or within a tolerance.

Rows are first collapsed to distinct feature vectors, both sides in one aggregate, so
any number of identical copies becomes one vector with a count and a lowest train id.
Vectors present on both sides are exact matches at distance zero and need no search.
The other test vectors look for their nearest train vector through a grid-cell join.

How the search stays bounded. The driver reads the number of candidate pairs, which is a
sum over cell counts. If it is too high at the asked tolerance, narrower radii go first:
a test vector with a neighbour inside a narrow radius is settled there, exactly, and
leaves the wider search. Cells that still hold too many pairs are cut into chunks of
train and test vectors that meet chunk by chunk in separate tasks. If chunks would repeat
the vectors too often, such cells are dealt into blocks instead, and no vector is repeated
(see ``blocks``). No candidate is dropped.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from leakscan.functions import grid, hashing, keys
from leakscan.operators import blocks
from leakscan.operators.lookup import lookup_join
from leakscan.operators.validate import CheckedInput, check_profile, input_profile
from leakscan.scratch import discard, materialize
from leakscan.settings import (
    BLOCK_MEETINGS,
    BLOCK_ROWS,
    BROADCAST_ROWS,
    CHUNK_ROWS,
    COPIES_PER_VECTOR,
    MAX_GRID_COLUMNS,
    MAX_LEVELS,
    MAX_PAIR_TASKS,
    MIN_COPIES,
    MIN_PAIR_BUDGET,
    PAIRS_PER_VECTOR,
    RADIUS_STEP,
    SALT_MIN_ROWS,
)
from leakscan.sources.pair import TRAIN, SplitPair

# Pairs that take as long to compare as one more copy of a test vector takes to shuffle, or to put into a block. Shuffled copies of
# more columns than PLAIN_WIDTH cost more in proportion.
SHUFFLE_COST = 20.0
PLAIN_WIDTH = 8
BLOCK_COPY_COST = 50_000.0

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class SearchLimits:
    """When the search narrows its radius, cuts cells into chunks or blocks, or salts a join."""

    pairs_per_vector: int = PAIRS_PER_VECTOR
    min_pair_budget: int = MIN_PAIR_BUDGET
    chunk_rows: int = CHUNK_ROWS
    max_levels: int = MAX_LEVELS
    broadcast_rows: int = BROADCAST_ROWS
    salt_min_rows: int = SALT_MIN_ROWS
    copies_per_vector: float = COPIES_PER_VECTOR
    min_copies: int = MIN_COPIES
    block_rows: int = BLOCK_ROWS
    block_meetings: int = BLOCK_MEETINGS


@dataclass(frozen=True)
class Matches:
    """Matched test vectors.

    ``vectors`` has one row per distinct matched test vector: its key columns, ``test_id``
    (lowest), ``n_test`` (number of test rows), ``train_id`` (nearest, lowest id on ties),
    ``distance`` (null without numeric features) and ``kind``.
    """

    checked: CheckedInput
    vectors: DataFrame
    key_columns: tuple[str, ...]
    test_rows: DataFrame
    salt_min_rows: int

    def rows(self) -> DataFrame:
        """One row per matched test row: ``test_id, train_id, distance, kind``."""
        found = self.vectors.drop("test_id") if "test_id" in self.test_rows.columns else self.vectors
        return lookup_join(
            self.test_rows, found, self.key_columns, "inner", "n_test", self.checked.n_test, self.salt_min_rows
        ).select("test_id", "train_id", "distance", "kind")

    def counts(self) -> DataFrame:
        """One row: ``exact_duplicate_rows, near_duplicate_rows``, counted in test rows."""
        return self.vectors.agg(*[
            F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n_test"))), F.lit(0)).alias(
                f"{kind}_duplicate_rows"
            )
            for kind in ("exact", "near")
        ])


def row_id(id_columns: Sequence[str]) -> Column:
    """The id column, or a struct of several."""
    columns = [F.col(f"`{name}`") for name in id_columns]
    return columns[0] if len(columns) == 1 else F.struct(*columns)


def classify(distance: Column, exact_atol: float) -> Column:
    return F.when(distance <= F.lit(exact_atol), "exact").otherwise("near")


def numbered(vectors: DataFrame) -> DataFrame:
    """With a number ``_row`` for each row, which stays the same only once the table is written."""
    return vectors.withColumn("_row", F.monotonically_increasing_id())


def lowest_id(name: str, among: str = "true") -> Column:
    """The lowest id of the rows ``among`` all; a missing id is below every other, as in the order of structs."""
    return F.expr(f"CASE WHEN count_if({among} AND {name} IS NULL) = 0 THEN min(CASE WHEN {among} THEN {name} END) END")


def _vector_columns(
    pair: SplitPair, numeric: Sequence[str], categorical: Sequence[str], schema: T.StructType
) -> list[Column]:
    columns = [F.expr(f"CAST(`{name}` AS double) AS _n{i}") for i, name in enumerate(numeric)]
    for i, name in enumerate(categorical):
        mixed = any(keys.is_mixed(dtype) for dtype in pair.types(name))
        columns += keys.equality_key(name, schema[name].dataType, f"_c{i}", mixed)
    return columns


def _vector_profile(vectors: DataFrame, vector: Sequence[str]) -> DataFrame:
    """What ``input_profile`` reports, from the collapsed vectors, so the source is scanned once."""
    numeric = [name for name in vector if name.startswith("_n")]
    lost = " OR ".join([f"{name} IS NULL" for name in vector] + [f"isnan({name})" for name in numeric])
    wild = " OR ".join(f"abs({name}) = CAST('Infinity' AS double)" for name in numeric)
    sides = []
    for side in ("train", "test"):
        rows = f"n_{side}"
        sides.append(
            vectors.where(F.col(rows) > 0).select(
                F.lit(side).alias("side"),
                F.col(rows).alias("n"),
                F.expr(f"if({lost}, {rows}, 0) AS lost"),
                F.expr(f"if({wild}, {rows}, 0) AS wild"),
                *numeric,
            )
        )
    return (
        sides[0].unionByName(sides[1])
        .groupBy("side")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum("lost").alias("rows_with_missing"),
            F.sum("wild").alias("rows_with_nonfinite"),
            *[F.expr(f"max(abs({name})) AS max_abs_{i}") for i, name in enumerate(numeric)],
        )
    )


def _no_matches(pair: SplitPair, collapsed: T.StructType) -> DataFrame:
    wanted = T.StructType([
        *collapsed.fields, T.StructField("distance", T.DoubleType()), T.StructField("kind", T.StringType())
    ])
    return pair.train.sparkSession.createDataFrame([], wanted).drop("n_train")


def find_matches(
    pair: SplitPair,
    numeric: Sequence[str],
    categorical: Sequence[str],
    near_atol: float,
    exact_atol: float,
    id_columns: Sequence[str] = (),
    limits: SearchLimits = SearchLimits(),
) -> Matches:
    """Nearest train vector for every test vector that has one within ``near_atol``.

    Without id columns only the feature columns are read, and a row is known by the hash of its
    feature vector. Raises ``InputError`` for an empty side and for missing or infinite values.
    """
    features = [*numeric, *categorical]
    possible = all(keys.comparable(*pair.types(name)) for name in categorical)
    checked = None
    if not (possible and numeric):
        checked = check_profile(input_profile(pair, features), numeric, categorical)
    if not possible:
        pair = SplitPair(pair.train, pair.train.limit(0))

    def columns(schema: T.StructType) -> list[Column]:
        ids = [row_id(id_columns).alias("_id")] if id_columns else []
        return [*_vector_columns(pair, numeric, categorical, schema), *ids]

    tagged = pair.tagged(columns)
    vector = [name for name in tagged.columns if name not in ("_id", TRAIN)]
    counts = {"n_train": F.count_if(F.col(TRAIN)), "n_test": F.count_if(~F.col(TRAIN))}
    if id_columns:
        lowest = {
            "train_id": F.min(F.when(F.col(TRAIN), F.col("_id"))),
            "test_id": F.min(F.when(~F.col(TRAIN), F.col("_id"))),
        }
    else:
        lowest = {}
    collapsed = tagged.groupBy(*vector).agg(*[value.alias(name) for name, value in {**lowest, **counts}.items()])
    if not id_columns:
        content = hashing.content_id(collapsed.select(*vector).schema)
        collapsed = collapsed.withColumns({
            f"{side}_id": F.when(F.col(f"n_{side}") > 0, content) for side in ("train", "test")
        }).select(*vector, "train_id", "test_id", *counts)
    on_both_sides = (F.col("n_train") > 0) & (F.col("n_test") > 0)
    test_rows = pair.test.select(*columns(pair.test.schema)).withColumnRenamed("_id", "test_id")
    if not possible:
        found = _no_matches(pair, collapsed.schema)
    elif not numeric:
        found = materialize(
            collapsed.where(on_both_sides).drop("n_train").withColumns(
                {"distance": F.lit(None).cast("double"), "kind": F.lit("exact")}
            ),
            "copies",
        )
    else:
        vectors = materialize(numbered(collapsed), "vectors")
        checked = check_profile(_vector_profile(vectors, vector), numeric, categorical)
        found = vectors.where(on_both_sides).drop("n_train", "_row").withColumn("distance", F.lit(0.0))
        if near_atol > 0:
            for level in _search(vectors, vector, [checked.largest[name] for name in numeric], near_atol, limits):
                found = found.unionByName(level)
        found = found.withColumn("kind", classify(F.col("distance"), exact_atol))
    return Matches(checked, found, tuple(vector), test_rows, limits.salt_min_rows)


@dataclass(frozen=True)
class _Grid:
    """A radius and the numeric columns whose cells are join keys at that radius.

    ``spare`` lists further columns that could join the grid, the most selective first. ``gains`` has for each column that could be in it
    how many copies of a test vector and what part of its candidates it makes. Without columns, one cell holds everything.
    """

    radius: float
    columns: tuple[int, ...]
    largest: tuple[float, ...]
    spare: tuple[int, ...] = ()
    gains: tuple[tuple[int, float, float], ...] = ()

    def wider(self) -> _Grid:
        return replace(self, columns=(*self.columns, self.spare[0]), spare=self.spare[1:])

    def for_blocks(self, n_train: int) -> _Grid:
        """The grid for blocks, whose pairs are cheap beside the copies of a vector."""
        used = _cheapest(self.gains, n_train, BLOCK_COPY_COST, 0) if self.gains else self.columns
        return replace(self, columns=used, spare=())

    def keys(self) -> list[str]:
        return [f"_g{i}" for i in self.columns] or ["_g"]

    def train(self, vectors: DataFrame) -> DataFrame:
        if not self.columns:
            return vectors.withColumn("_g", F.lit(0))
        for i in self.columns:
            width = grid.cell_width(self.radius, self.largest[i])
            vectors = vectors.withColumn(f"_g{i}", grid.home_cell(F.col(f"_n{i}"), width))
        return vectors

    def test(self, vectors: DataFrame, reach: str | None = None) -> DataFrame:
        """Rows per cell within the radius, or within the distance in the column ``reach``, which is no larger."""
        if not self.columns:
            return vectors.withColumn("_g", F.lit(0))
        for i in self.columns:
            width = grid.cell_width(self.radius, self.largest[i])
            pad = grid.padding(self.radius if reach is None else F.col(reach), self.largest[i])
            vectors = vectors.withColumn(f"_g{i}", grid.touched_cells(F.col(f"_n{i}"), width, pad))
        return vectors


def _cheapest(gains: Sequence[tuple[int, float, float]], n_train: float, copy_cost: float, least: int) -> tuple[int, ...]:
    """The first columns of ``gains``, at least so many, that cost least: a copy as much as comparing ``copy_cost`` pairs."""
    best, best_cost, copies, crowd = (), math.inf if least else copy_cost + n_train, 1.0, float(n_train)
    for used, (_, more, gain) in enumerate(gains, start=1):
        copies *= more
        crowd /= gain
        if used <= least or copies * copy_cost + crowd < best_cost:
            best, best_cost = tuple(i for i, *_ in gains[:used]), copies * copy_cost + crowd
    return best


def _choose_grid(train: DataFrame, test: DataFrame, largest: Sequence[float], radius: float):
    """Vector counts per side and the grid columns with the lowest estimated cost.

    A column divides the candidates of a test vector by its number of distinct train cells and
    multiplies the test entries by the cells a test vector touches; both are measured, for every column.
    """
    widths = [grid.cell_width(radius, size) for size in largest]
    looked_at = range(len(largest))
    cells = {i: grid.home_cell(F.col(f"_n{i}"), widths[i]) for i in looked_at}
    touched = {
        i: grid.touched_count(F.col(f"_n{i}"), widths[i], grid.padding(radius, largest[i])) for i in looked_at
    }
    values = [f"_n{i}" for i in looked_at]
    stats = (
        train.selectExpr(*values, f"true AS {TRAIN}")
        .unionByName(test.selectExpr(*values, f"false AS {TRAIN}"))
        .agg(
            F.count_if(F.col(TRAIN)).alias("n_train"),
            F.count_if(~F.col(TRAIN)).alias("n_test"),
            *[F.approx_count_distinct(F.when(F.col(TRAIN), cells[i]), 0.05).alias(f"_d{i}") for i in looked_at],
            *[F.avg(F.when(~F.col(TRAIN), touched[i])).alias(f"_a{i}") for i in looked_at],
        )
        .first()
    )
    copies_of = {i: stats[f"_a{i}"] or 1.0 for i in looked_at}
    gain = {i: max(stats[f"_d{i}"], 1) / copies_of[i] for i in looked_at}
    order = sorted(looked_at, key=lambda i: (-gain[i], i))
    gains = tuple((i, copies_of[i], gain[i]) for i in order[:MAX_GRID_COLUMNS])
    best = _cheapest(gains, stats["n_train"], SHUFFLE_COST * max(1.0, len(largest) / PLAIN_WIDTH), 1)
    spare = tuple(i for i in order[len(best) : MAX_GRID_COLUMNS] if gain[i] > 1.0)
    return stats["n_train"], stats["n_test"], _Grid(radius, best, tuple(largest), spare, gains)


def _cell_counts(train: DataFrame, test: DataFrame, cells: _Grid, categories: Sequence[str]) -> DataFrame:
    on = [*categories, *cells.keys()]
    ours = cells.train(train).select(*on, F.lit(1).alias("_t"), F.lit(0).alias("_q"))
    theirs = cells.test(test).select(*on, F.lit(0).alias("_t"), F.lit(1).alias("_q"))
    return (
        ours.unionByName(theirs)
        .groupBy(*on)
        .agg(F.sum("_t").alias("_t"), F.sum("_q").alias("_q"))
        .where((F.col("_t") > 0) & (F.col("_q") > 0))
    )


def _pair_work(counts: DataFrame, chunk_rows: int) -> tuple[float, int]:
    """Candidate pairs over all cells, and the number of cells to cut into chunks."""
    pairs = F.col("_t").cast("double") * F.col("_q")
    row = counts.agg(
        F.coalesce(F.sum(pairs), F.lit(0.0)).alias("work"),
        F.count_if(pairs > F.lit(float(chunk_rows) ** 2)).alias("hot"),
    ).first()
    return row["work"], row["hot"]


def _measured(
    train: DataFrame, test: DataFrame, cells: _Grid, categories: Sequence[str], budget: float, limits: SearchLimits
) -> tuple[_Grid, float, int]:
    """The grid with its measured work; it gets more columns while they halve work above the budget.

    Estimates assume that values spread evenly. Clustered data shows only in the measured cells.
    """
    work, hot = _pair_work(_cell_counts(train, test, cells, categories), limits.chunk_rows)
    while work > budget and cells.spare:
        wider = cells.wider()
        less, fewer = _pair_work(_cell_counts(train, test, wider, categories), limits.chunk_rows)
        if less > work / 2:
            break
        cells, work, hot = wider, less, fewer
    return cells, work, hot


def _search(
    vectors: DataFrame, vector: Sequence[str], largest: Sequence[float], near_atol: float, limits: SearchLimits
) -> list[DataFrame]:
    """Settled test vectors, one written table per radius."""
    categories = [name for name in vector if not name.startswith("_n")]
    train = vectors.where(F.col("n_train") > 0).select(*vector, "train_id", F.col("_row").alias("_train"))
    test = vectors.where(F.col("n_train") == 0).select(*vector, "test_id", "n_test", F.col("_row").alias("_test"))

    n_train, n_test, cells = _choose_grid(train, test, largest, near_atol)
    if n_test == 0:
        return []
    budget = max(limits.min_pair_budget, limits.pairs_per_vector * (n_train + n_test))
    if float(n_train) * n_test <= min(budget, limits.chunk_rows**2):
        return [materialize(_nearest(train, test, cells, categories, vector), "near")]

    plan = [_measured(train, test, cells, categories, budget, limits)]
    while plan[0][1] > budget and len(plan) < limits.max_levels:
        _, _, finer = _choose_grid(train, test, largest, plan[0][0].radius / RADIUS_STEP)
        step = _measured(train, test, finer, categories, budget, limits)
        if step[1] >= plan[0][1]:
            break
        plan.insert(0, step)

    settled = []
    for step, (cells, work, hot) in enumerate(plan):
        if step > 0 and hot:  # fewer test vectors than planned: cells that were not hot have not become so
            work, hot = _pair_work(_cell_counts(train, test, cells, categories), limits.chunk_rows)
        log.info("radius %g, grid on %s: %.0f candidate pairs, %d hot cells", cells.radius, cells.keys(), work, hot)
        chunks = _chunk_table(_cell_counts(train, test, cells, categories), limits.chunk_rows) if hot else None
        hinted = F.broadcast(chunks) if hot and hot <= limits.broadcast_rows else chunks
        if hot and _copies(chunks, limits) > max(limits.min_copies, limits.copies_per_vector * (n_train + n_test)):
            discard(chunks)
            chunks = None
            level = _nearest_by_blocks(train, test, cells.for_blocks(n_train), categories, vector, limits)
        else:
            level = materialize(_nearest(train, test, cells, categories, vector, hinted, _parts(vectors, work, limits)), "near")
        settled.append(level)
        rest = test
        if step + 1 < len(plan):
            rest = materialize(test.join(level.select(*vector), list(vector), "left_anti"), "unsettled")
        discard(*[table for table in (chunks, test) if table is not None and table is not rest])
        test = rest
    discard(test)
    return settled


def _parts(vectors: DataFrame, work: float, limits: SearchLimits) -> int:
    """Tasks for so many pairs: about four for each full meeting of two chunks, as hashing deals these out unevenly."""
    usual = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, min(MAX_PAIR_TASKS, math.ceil(4 * work / limits.chunk_rows**2)))


def _chunk_table(counts: DataFrame, chunk_rows: int) -> DataFrame:
    pairs = F.col("_t").cast("double") * F.col("_q")
    cut = counts.where(pairs > F.lit(float(chunk_rows) ** 2)).select(
        *[name for name in counts.columns if name not in ("_t", "_q")],
        F.ceil(F.col("_t") / F.lit(chunk_rows)).cast("int").alias("_tc"),
        F.ceil(F.col("_q") / F.lit(chunk_rows)).cast("int").alias("_qc"),
        F.monotonically_increasing_id().alias("_cell"),
    )
    return materialize(cut, "hot_cells")


def _copies(chunks: DataFrame, limits: SearchLimits) -> float:
    """How many rows all vectors of hot cells become when each is repeated for every chunk of the other side, at most."""
    return chunks.agg(F.sum(F.expr("CAST(_tc AS double) * _qc"))).first()[0] * 2 * limits.chunk_rows


def _chunked(entries: DataFrame, chunks: DataFrame, on: Sequence[str], own: str, other: str, vector: Sequence[str]) -> DataFrame:
    """Put each entry in one chunk of its side, by its vector, and repeat it for every chunk of the other side."""
    spread = F.pmod(F.xxhash64(*vector), F.coalesce(F.col(own), F.lit(1)).cast("bigint")).cast("int")
    return (
        entries.join(chunks, list(on), "left")
        .withColumn(f"_own{own}", spread)
        .withColumn(f"_own{other}", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
        .drop("_tc", "_qc", "_cell")
    )


def _pairs(
    train: DataFrame,
    test: DataFrame,
    cells: _Grid,
    categories: Sequence[str],
    vector: Sequence[str],
    chunks: DataFrame | None,
    reach: str | None = None,
    parts: int = 0,
    without: DataFrame | None = None,
) -> DataFrame:
    """Test rows with each train row within the grid's radius, or within their own ``reach``, and ``_distance``.

    ``parts`` tasks share the meetings of chunks, whose rows are few beside their pairs: by their size adaptive
    execution would put them all into one task. Cells of the table ``without`` are left out.
    """
    on = [*categories, *cells.keys()]
    numeric = [name for name in vector if name.startswith("_n")]
    ours, theirs = cells.train(train), cells.test(test, reach)
    if without is not None:
        ours, theirs = ours.join(without, on, "left_anti"), theirs.join(without, on, "left_anti")
    if chunks is not None:
        ours = _chunked(ours, chunks, on, "_tc", "_qc", vector)
        theirs = _chunked(theirs, chunks, on, "_qc", "_tc", vector)
        on = [*on, "_own_tc", "_own_qc"]
    kept = [name for name in train.columns if name not in vector]
    ours = ours.selectExpr(*on, *kept, *[f"{name} AS {name}t" for name in numeric])
    other = [f"{name}t" for name in numeric]
    if chunks is not None and parts:
        ours, theirs = ours.repartition(parts, *on), theirs.repartition(parts, *on)
    return theirs.join(ours, on).where(grid.within(numeric, other, reach or cells.radius)).withColumn("_distance", grid.chebyshev(numeric, other))


def _nearest(
    train: DataFrame,
    test: DataFrame,
    cells: _Grid,
    categories: Sequence[str],
    vector: Sequence[str],
    chunks: DataFrame | None = None,
    parts: int = 0,
) -> DataFrame:
    """Nearest train vector within the grid's radius for each test vector that has one.

    The least distance comes first and the lowest train id at that distance second, from the cells that this distance reaches.
    So a hash aggregate takes in the pairs as they come; the least pair of both would be a struct, for which Spark sorts all pairs.
    """
    known = [*vector, "test_id", "n_test"]
    least = (
        _pairs(train, test, cells, categories, vector, chunks, parts=parts)
        .groupBy(*known)
        .agg(F.min("_distance").alias("distance"))
    )
    return (
        _pairs(train, least, cells, categories, vector, chunks, "distance", parts)  # nothing is nearer than the least distance
        .groupBy(*known, "distance")
        .agg(lowest_id("train_id").alias("train_id"))
        .select(*vector, "train_id", "test_id", "n_test", "distance")
    )


def _nearest_by_blocks(
    train: DataFrame,
    test: DataFrame,
    cells: _Grid,
    categories: Sequence[str],
    vector: Sequence[str],
    limits: SearchLimits,
) -> DataFrame:
    """What ``_nearest`` gives, written, with the hot cells dealt into blocks, so that disk grows with the vectors, not the pairs.

    Vectors travel once and under their numbers; ids join the nearest ones at the end. Blocks hold train vectors by their ids, so that the
    first of equally near ones is the lowest.
    """
    on = [*categories, *cells.keys()]
    chunks = _chunk_table(_cell_counts(train, test, cells, categories), limits.chunk_rows)
    hot = chunks.count()
    hinted = F.broadcast(chunks) if hot <= limits.broadcast_rows else chunks
    log.info("radius %g, grid on %s: %d cells in blocks", cells.radius, cells.keys(), hot)
    cut = hinted.select(
        *on,
        "_cell",
        F.ceil(F.col("_tc") * F.lit(limits.chunk_rows) / F.lit(block_rows := blocks.rows_per_block(len(cells.largest), limits.block_rows))).cast("int").alias("_tb"),
        F.ceil(F.col("_qc") * F.lit(limits.chunk_rows) / F.lit(block_rows)).cast("int").alias("_qb"),
    )
    large = F.col("_tb").cast("double") * F.col("_qb") > limits.block_meetings
    numeric = [name for name in vector if name.startswith("_n")]

    def dealt(entries: DataFrame, some: Column, row: str, own: str, number: float, order: Sequence[Column] = ()) -> DataFrame:
        entries = entries.join(cut.where(some), on).withColumn("_block", F.pmod(F.xxhash64(row), F.col(own).cast("bigint")).cast("int"))
        usual = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(usual, min(MAX_PAIR_TASKS, int(number)))
        return materialize(blocks.blocks(entries, row, numeric, parts, order), "blocks")

    def met(some: Column, within_cell: bool, n_train: float, n_test: float) -> DataFrame:
        tests = dealt(cells.test(test), some, "_test", "_qb", n_test)
        trains = dealt(cells.train(train), some, "_train", "_tb", n_train, [F.col("train_id").asc_nulls_first()])
        found = blocks.met(tests, trains, within_cell, cells.radius, cells.largest)
        discard(tests, trains)
        return found

    small = cut.agg(*[F.coalesce(F.sum(F.when(~large, F.col(name))), F.lit(0)).alias(name) for name in ("_tb", "_qb")]).first()
    found = [met(F.col("_cell") == row["_cell"], False, row["_tb"], row["_qb"]) for row in cut.where(large).select("_cell", "_tb", "_qb").collect()]
    if small["_tb"]:
        found.append(met(~large, True, small["_tb"], small["_qb"]))

    hits = train.sparkSession.createDataFrame([], "_test long, _train long, distance double")
    for some in found:
        hits = hits.unionByName(some)
    hits = hits.join(train.select("_train", "train_id"), "_train").select("_test", "train_id", "distance")
    known = train.select(*vector, "train_id")
    least = _pairs(known, test, cells, categories, vector, None, without=hinted.select(*on)).groupBy("_test").agg(F.min("_distance").alias("distance"))
    least = materialize(least, "least")
    again = test.join(least, "_test")
    hits = hits.unionByName(
        _pairs(known, again, cells, categories, vector, None, "distance", without=hinted.select(*on))
        .groupBy("_test", "distance").agg(lowest_id("train_id").alias("train_id"))
    )
    best = hits.groupBy("_test").agg(F.min("distance").alias("distance"))
    lowest = hits.join(best, ["_test", "distance"]).groupBy("_test", "distance").agg(lowest_id("train_id").alias("train_id"))
    level = materialize(test.join(lowest, "_test").select(*vector, "train_id", "test_id", "n_test", "distance"), "near")
    discard(least, chunks, *found)
    return level
