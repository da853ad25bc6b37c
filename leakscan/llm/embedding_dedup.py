"""Near-duplicate embeddings with a forest of random-projection trees.

Every tree splits the vectors again and again at a random direction, near the median of a bounded
sample; vectors in the middle go to both sides (spill). Vectors that share a leaf of any tree
are compared by cosine in double precision. Equal vectors are one class that carries its number of copies.
A pair is counted in the first leaf that its vectors share and nowhere else, so a leaf returns sums of
links and a spanning forest instead of pairs. A node whose vectors are mostly alike is not split. Leaves above LEAF_BLOCK vectors are compared in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leakscan.llm.common import attach, grouped, materialize
from leakscan.llm.components import components

LEAF_BLOCK = 1024
#: Mean cosine from which a node is not split further: it would part pairs that belong together.
TIGHT = 0.7
LEAF_BITS = 24


@dataclass(frozen=True)
class Forest:
    """``leaf``: vectors that a leaf should hold; ``spill``: share of a node that goes to both sides.

    ``sample`` bounds the vectors on which splits are fitted. Nodes are split while they hold 8 of the sample, so leaves keep
    their size up to ``sample * leaf / 8`` distinct vectors and grow beyond; give larger tables a larger sample.
    """

    trees: int = 10
    leaf: int = 128
    spill: float = 0.1
    sample: int = 16_384
    seed: int = 7
    cosine: float = 0.9


def _grow(points: np.ndarray, size: int, spill: float, rng: np.random.Generator):
    """Splits (direction, low, high, left, right) of one tree; children are numbers of splits, or leaves as -1 - leaf."""
    splits, leaves = [], 0

    def node(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > size and np.square(points[rows].mean(axis=0)).sum() < TIGHT:
            direction = rng.standard_normal(points.shape[1])
            along = points[rows] @ direction
            low, high = np.quantile(along, [0.5 - spill / 2, 0.5 + spill / 2])
            left, right = rows[along < high], rows[along >= low]
            if 0 < len(left) < len(rows) and 0 < len(right) < len(rows):
                number = len(splits)
                splits.append(None)
                splits[number] = (direction, low, high, node(left), node(right))
                return number
        leaves += 1
        return -leaves

    root = node(np.arange(len(points)))
    return splits, root


def _route(tree, points: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Leaves with the rows of ``points`` that reach them."""
    splits, root = tree
    found, open_nodes = [], [(root, np.arange(len(points)))]
    while open_nodes:
        number, rows = open_nodes.pop()
        if not len(rows):
            continue
        if number < 0:
            found.append((-1 - number, rows))
            continue
        direction, low, high, left, right = splits[number]
        along = points[rows] @ direction
        open_nodes += [(left, rows[along < high]), (right, rows[along >= low])]
    return found


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit name for each usable vector: not null, no null or non-finite component, not zero."""
    for batch in batches:
        names = []
        for vector in batch.column("vector"):
            values = vector.values
            usable = values is not None and len(values) > 0 and values.null_count == 0
            if usable:
                values = values.to_numpy() + 0.0
                usable = bool(np.isfinite(values).all() and values.any())
            names.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if usable else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], [*batch.schema.names, "name"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _placed(forest):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _unit(_matrix(batch.column("vector")))
            leaves: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for number, tree in enumerate(trees):
                for leaf, rows in _route(tree, points):
                    for row in rows:
                        leaves[row].append(number << LEAF_BITS | leaf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(sorted, leaves), pa.list_(pa.int32()))], [*batch.schema.names, "leaves"])

    return place


def _compared(cosine: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ("leaf", "low", "high")):
            leaf, block = table.column("leaf")[0].as_py(), table.column("block").to_numpy()
            first, second = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("low", "high"))
            points = _unit(_matrix(table.column("vector").combine_chunks()))
            a, b = np.nonzero(points[first] @ points[second].T >= cosine)
            a, b = first[a], second[b]
            if table.column("low")[0] == table.column("high")[0]:
                a, b = a[a < b], b[a < b]
            known = table.column("leaves").to_pylist()
            earlier = np.full((table.num_rows, max(map(len, known))), -1)
            for i, mine in enumerate(known):
                mine = [x for x in mine if x < leaf]
                earlier[i, : len(mine)] = mine
            fresh = np.ones(len(a), bool)
            for at in range(0, len(a), 4096):
                mine, other = earlier[a[at : at + 4096]], earlier[b[at : at + 4096]]
                fresh[at : at + 4096] = ~((mine[:, :, None] == other[:, None, :]) & (mine[:, :, None] >= 0)).any(axis=(1, 2))
            a, b = a[fresh], b[fresh]
            nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
            links, parent = np.zeros(table.num_rows, np.int64), np.arange(table.num_rows)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])

            def root(x):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_pydict({"node": nodes[some], "links": links[some], "root": nodes[[root(x) for x in some]] if len(some) else nodes[:0]})

    return compare


def embedding_duplicates(vectors: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): ``n_links``, ``component_id`` and ``kept``.

    Null, empty and zero vectors and vectors with null or non-finite components link with nothing, nor do vectors whose length is
    not the most frequent one (of equally frequent ones the longest). Repeated rows are copies of each other; rows without ``vec_id`` take part and ``component_id`` is the
    smallest id that there is. All rows are indexed; a pair is missed only where every tree separates it.
    """
    spark = vectors.sparkSession
    element = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.monotonically_increasing_id().alias("row_id"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("vector"))
    rows = materialize(rows.mapInArrow(_named, f"row_id long, vec_id long, vector array<{element}>, name binary"), "vectors")
    lengths = rows.where("name is not null").groupBy(F.size("vector").alias("length")).count()
    length = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    if length is not None:
        rows = rows.withColumn("name", F.when(F.size("vector") == length[0], F.col("name")))
    classes = materialize(rows.where("name is not null").groupBy("name").agg(
        F.min("row_id").alias("node"), F.min("vec_id").alias("low_id"), F.count("*").alias("copies"), F.any_value("vector").alias("vector")
    ), "classes")
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("name"), "name").limit(forest.sample).select("vector").toArrow().column("vector")
    size = max(8, round(forest.leaf * len(sample) / max(1, total)))
    points = _unit(_matrix(sample.combine_chunks())) if len(sample) else np.zeros((0, 1))
    trees = [_grow(points, size, forest.spill, np.random.default_rng([forest.seed, i])) for i in range(forest.trees)]
    placed = classes.select("node", "copies", "vector").mapInArrow(_placed(spark.sparkContext.broadcast(trees)), f"node long, copies long, vector array<{element}>, leaves array<int>")
    placed = materialize(placed, "placed")
    members = placed.select(F.explode("leaves").alias("leaf"), "node", "copies", "vector", "leaves")
    # one row per leaf of the forest, which the sample bounds
    sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / LEAF_BLOCK).cast("int").alias("blocks"))
    cut = members.join(F.broadcast(sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    dealt = met.drop("other", "blocks").repartition("leaf", "low", "high").sortWithinPartitions("leaf", "low", "high")
    found = materialize(dealt.mapInArrow(_compared(forest.cosine), "node long, links long, root long"), "links")
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = classes.drop("vector").join(roots, "node", "left").join(sums, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = labelled.groupBy("root").agg(F.min("low_id").alias("component"))
    named = materialize(labelled.join(lowest, "root").select("name", "component", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    result = attach(rows.select("vec_id", "name"), named, ["name"], "copies")
    component = F.when(F.col("name").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
