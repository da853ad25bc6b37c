"""Exact binary metrics from a score column, without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from leakscan.scratch import materialize
from leakscan.settings import THRESHOLD

METRICS = ("accuracy", "f1", "roc_auc", "average_precision")


def threshold_predict(score: Column, threshold: float = THRESHOLD) -> Column:
    """Class 1 from the threshold upwards."""
    return (score >= F.lit(threshold)).cast("int")


def _curve(scored: DataFrame, score: str, target: str, ranges: int | None) -> DataFrame:
    """Per distinct score: positives ``p``, negatives ``q``, and running totals from the highest score down.

    Scores are range-partitioned once and written, which freezes the range of each score. Running
    totals then need a window inside each range plus the totals of the ranges before it.
    """
    value, label = F.col(f"`{score}`").cast("double"), F.col(f"`{target}`").cast("int")
    value = F.when(value.isNotNull() & ~F.isnan(value), value).otherwise(F.raise_error(F.lit("a score is missing")))
    label = F.when(label.isin(0, 1), label).otherwise(F.raise_error(F.lit("the target must be 0 or 1")))
    per_score = (
        scored.select(value.alias("score"), label.alias("_y"))
        .groupBy("score")
        .agg(F.sum("_y").cast("bigint").alias("p"), F.sum(1 - F.col("_y")).cast("bigint").alias("q"))
    )
    ranges = ranges or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        per_score.repartitionByRange(ranges, F.desc("score")).withColumn("_range", F.spark_partition_id()),
        "score_ranges",
    )
    # One row per range: at most ``ranges`` rows, so one window task and a broadcast are safe.
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q")).select(
        "_range",
        F.coalesce(F.sum("_p").over(earlier), F.lit(0)).alias("_before_p"),
        F.coalesce(F.sum("_q").over(earlier), F.lit(0)).alias("_before_q"),
    )
    running = Window.partitionBy("_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(before), "_range").select(
        "score",
        "p",
        "q",
        (F.col("_before_p") + F.sum("p").over(running)).alias("tp"),
        (F.col("_before_q") + F.sum("q").over(running)).alias("fp"),
    )


def binary_metrics(
    scored: DataFrame,
    score: str = "score",
    target: str = "y",
    threshold: float = THRESHOLD,
    ranges: int | None = None,
) -> DataFrame:
    """One row: the four metrics and the number of rows. Undefined ranking metrics are null."""
    curve = _curve(scored, score, target, ranges)
    called = threshold_predict(F.col("score"), threshold) == 1
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    sums = curve.agg(
        F.sum(p).alias("P"),
        F.sum(q).alias("N"),
        F.sum(F.when(called, p).otherwise(0.0)).alias("hit"),
        F.sum(F.when(called, q).otherwise(0.0)).alias("false_alarm"),
        F.sum(q * (tp - p / 2)).alias("below"),
        F.sum(p * tp / (tp + fp)).alias("precision_mass"),
    )
    hit, alarm, positives, negatives = (F.col(name) for name in ("hit", "false_alarm", "P", "N"))
    both = (positives > 0) & (negatives > 0)
    return sums.select(
        ((hit + negatives - alarm) / (positives + negatives)).alias("accuracy"),
        F.coalesce(F.try_divide(2 * hit, hit + positives + alarm), F.lit(0.0)).alias("f1"),
        F.when(both, F.try_divide(F.col("below"), positives * negatives)).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("precision_mass"), positives)).alias("average_precision"),
        (positives + negatives).cast("bigint").alias("n_rows"),
    )


def metric_gap(scores: DataFrame, leaky: str = "leaky", clean: str = "clean", metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row: leaky minus clean for each metric of ``scores``, which has a ``key`` column."""
    def value(name: str, key: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.col(name)))

    return scores.where(F.col("key").isin(leaky, clean)).agg(
        *[(value(name, leaky) - value(name, clean)).alias(f"{name}_gap") for name in metrics]
    )


def dataset_profile(table: DataFrame, group: str, target: str) -> DataFrame:
    """One row: rows, distinct groups, positive rate."""
    return table.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(F.col(f"`{group}`")).alias("n_groups"),
        F.avg(F.col(f"`{target}`").cast("double")).alias("positive_rate"),
    )
