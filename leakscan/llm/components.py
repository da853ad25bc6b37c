"""Connected components by alternating large-star and small-star steps, written to the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leakscan.llm.common import materialize
from leakscan.scratch import discard

ROUNDS = 60


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    linked = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return linked.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of ``edges`` (u, v) but the roots.

    Steps use map-side minima, and joins on a node with very many neighbours are split by adaptive execution.
    """
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    current = materialize(_tidy(edges), "edges")
    before = mark(current)
    for _ in range(ROUNDS):
        if not before[0]:
            break
        following = materialize(_small_star(_large_star(current)), "edges")
        now = mark(following)
        discard(current)
        current = following
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
