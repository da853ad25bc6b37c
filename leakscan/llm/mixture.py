"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, divided by its quality weight. A source first takes
whole epochs; the rest of its target goes to the documents with the smallest keys, by prefix
sums of their sizes, and the gap before the next document to the one that fills it best. The prefix sums need no ordered pass over a source: keys fall into
buckets, bucket sums are added up per source, and only the bucket that holds the cut is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leakscan.llm.common import SEPARATORS, attach, materialize, null_safe, packed_row, words

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
KEY_BUCKETS = 4096
ODD_CHARACTERS = "0123456789#*$%&|<>"
LEAST_QUALITY = 0.05


def text_size(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Share of characters that are neither digits nor symbols, at least LEAST_QUALITY; 1 for no text."""
    share = F.length(F.translate(text, ODD_CHARACTERS, "")) / F.length(text)
    return F.coalesce(F.when(F.length(text) > 0, F.greatest(share, F.lit(LEAST_QUALITY))), F.lit(1.0))


def exponential_key(seed: int, name: Column, quality: Column) -> Column:
    """-ln(u) / quality, with u in (0, 1) from 52 bits of the MD5 of seed and name."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / quality


def source_plan(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: its size, target, whole epochs and the rest.

    Targets share the total by weight; a target stops at ``cap`` times its source's size and the excess goes to
    the others by weight. Sources are few beside documents: they are ordered in one task, one row each.
    """
    sums = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source_key") == "~", "source_key")
    share = F.array(*map(F.lit, map(float, weights)))
    ranked = sums.withColumn("weight", F.get(share, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    limit = (cap * F.col("source_size")).cast("double")
    by_ratio = Window.orderBy(limit / F.col("weight"), "source_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    leveled = ranked.withColumn("level", level).withColumn("capped", limit / F.col("weight") <= F.col("level"))
    rest = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), limit).otherwise(F.coalesce(F.least(F.col("weight") * rest, limit), F.lit(0.0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return leveled.withColumn("target", target).withColumn("epochs", epochs).select(
        "source_key", "source_size", "n_docs", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest")
    )


def _draw(sized: DataFrame, weights, cap: int) -> DataFrame:
    plan = source_plan(sized, weights, cap)
    sums = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    running = Window.partitionBy("source_key").orderBy("bucket")
    upto = sums.withColumn("upto", F.sum("bucket_size").over(running)).join(plan.select("source_key", "rest"), "source_key")
    cut = upto.where(F.col("upto") >= F.col("rest")).groupBy("source_key").agg(
        F.min(F.struct("bucket", (F.col("upto") - F.col("bucket_size")).alias("below"))).alias("cut")
    )
    plan = materialize(plan.join(cut, "source_key", "left").select("*", "cut.bucket", "cut.below").drop("cut").withColumnRenamed("bucket", "cut_bucket"), "plan")
    placed = attach(sized, plan, ["source_key"], "n_docs")
    at_cut = F.coalesce(F.col("bucket") == F.col("cut_bucket"), F.lit(False))
    ordered = Window.partitionBy("source_key").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("below") + F.coalesce(F.sum("size").over(ordered), F.lit(0))
    edge = placed.where(at_cut).withColumn("extra", (first + F.col("size") <= F.col("rest")).cast("long"))
    other = placed.where(~at_cut).withColumn("extra", F.coalesce(F.col("bucket") < F.col("cut_bucket"), F.lit(False)).cast("long"))
    drawn = other.unionByName(edge)
    gap = F.max("rest") - F.sum(F.col("extra") * F.col("size"))
    gaps = materialize(drawn.groupBy("source_key").agg(gap.alias("gap"), F.count("*").alias("n")), "gaps")
    left = attach(drawn.where("extra = 0 and size > 0").select("source_key", "row_id", "key", "size"), gaps, ["source_key"], "n", "inner")
    miss = F.abs(F.col("size") - F.col("gap"))
    last = materialize(left.where(miss < F.col("gap")).groupBy("source_key").agg(
        F.min(F.struct(miss, "key", "row_id")).alias("best"), F.count("*").alias("n")
    ).select("source_key", F.col("best.row_id").alias("last_row"), "n"), "last")
    topped = attach(drawn, last, ["source_key"], "n")
    extra = F.when(F.col("row_id") == F.col("last_row"), F.lit(1)).otherwise(F.col("extra"))
    return topped.withColumn("copies", F.when(F.col("epochs") >= cap, F.lit(cap)).otherwise(F.col("epochs") + extra))


def _sized(docs: DataFrame, seed: int, keep_row: bool) -> DataFrame:
    text = docs["text"]
    name = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("null|"), F.coalesce(F.md5(text), F.lit("null"))))
    frame = packed_row(
        docs if keep_row else docs.select("doc_id", "text", "source"),
        doc_id=docs["doc_id"], source_key=null_safe(docs["source"]), size=text_size(text), key=exponential_key(seed, name, text_quality(text)),
    )
    frame = frame if keep_row else frame.drop("row")
    frame = frame.withColumn("row_id", F.monotonically_increasing_id())
    return materialize(frame.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * KEY_BUCKETS).cast("int")), "sized")


def mix_report(docs: DataFrame, seed: int = 42, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per row of ``docs``: its size in words, its source's size and target, and the words taken.

    Null text has size 0; null sources form one source, ordered last; equal keys go by id, then size, so repeated
    rows are drawn one by one; an empty table gives an empty result.
    """
    drawn = _draw(_sized(docs, seed, keep_row=False), weights, cap)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 42, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken. Rows without words are not taken."""
    drawn = _draw(_sized(docs, seed, keep_row=True), weights, cap).where((F.col("size") > 0) & (F.col("copies") > 0))
    return drawn.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
