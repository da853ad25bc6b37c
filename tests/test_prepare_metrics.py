"""Splits, encoders, scalers, metrics and fingerprints against plain Python."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscan import (
    InputError,
    apply_scaler,
    apply_target_encoding,
    binary_metrics,
    dataset_profile,
    fit_rows,
    fit_scaler,
    fit_target_encoding,
    group_split,
    metric_gap,
    stratified_row_split,
    table_fingerprint,
)
from leakscan.operators.lookup import lookup_join


def rank(seed, value):
    return hashlib.md5(f"{seed}|{value}".encode()).hexdigest()


@pytest.mark.parametrize("bucket_rows", [100_000, 20])
def test_stratified_split_takes_the_lowest_hashes_of_each_class(spark, table, bucket_rows):
    orders = table("orders")
    rows = stratified_row_split(orders, "o_orderkey", "o_orderstatus", 7, bucket_rows=bucket_rows).collect()
    n_test = math.ceil(0.25 * len(rows))
    test = {r.o_orderkey for r in rows if r.split == "test"}
    assert len(test) == n_test
    for status in {r.o_orderstatus for r in rows}:
        ids = sorted((r.o_orderkey for r in rows if r.o_orderstatus == status), key=lambda i: rank(7, i))
        taken = [i for i in ids if i in test]
        assert abs(len(taken) - 0.25 * len(ids)) < 1
        assert taken == ids[: len(taken)]


@pytest.mark.parametrize("bucket_rows", [100_000, 5])
def test_group_split_keeps_groups_whole(spark, table, bucket_rows):
    rows = group_split(table("orders"), "o_custkey", 7, bucket_rows=bucket_rows).collect()
    groups = sorted({r.o_custkey for r in rows}, key=lambda g: rank(7, g))
    test = {r.o_custkey for r in rows if r.split == "test"}
    assert test == set(groups[: math.ceil(0.25 * len(groups))])
    assert not test & {r.o_custkey for r in rows if r.split == "train"}


def test_splits_reject_missing_values(spark):
    frame = spark.createDataFrame([(1, None), (2, "a")], "id bigint, g string")
    with pytest.raises(InputError, match="missing"):
        group_split(frame, "g")
    with pytest.raises(InputError, match="missing"):
        stratified_row_split(frame, "id", "g")


def test_split_seed_changes_the_split(spark, table):
    first, again, other = (
        {r.o_orderkey for r in group_split(table("orders"), "o_custkey", seed).where("split = 'test'").collect()}
        for seed in (1, 1, 2)
    )
    assert first == again != other


def test_target_encoding(spark):
    rows = spark.createDataFrame(
        [(1, "a", 1), (2, "a", 0), (3, "b", 1), (4, None, 1), (5, "", 0)], "id int, code string, y int"
    )
    encoding, mean = fit_target_encoding(rows, "code", "y")
    assert mean == pytest.approx(0.6)
    got = {r.code: (r.encoded, r.n) for r in encoding.collect()}
    assert got["a"] == (pytest.approx((1 + 0.6) / 3), 2)
    assert got[None] == (pytest.approx(0.8), 1)
    assert got[""] == (pytest.approx(0.3), 1)
    new = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "id int, code string")
    for salted in (None, 0):
        options = {} if salted is None else {"n_rows": 5, "salt_min_rows": 0}
        applied = apply_target_encoding(new, encoding, mean, "code", **options)
        assert applied.columns == ["id", "code", "encoded"]
        assert {r.id: r.encoded for r in applied.collect()} == {
            1: pytest.approx(1.6 / 3), 2: pytest.approx(0.6), 3: pytest.approx(0.8)
        }
    with pytest.raises(InputError, match="missing"):
        fit_target_encoding(rows.withColumn("y", F.lit(None).cast("int")), "code", "y")
    with pytest.raises(ValueError, match="population"):
        fit_rows(rows, "test")


def test_scaler_uses_population_deviation_and_survives_constants(spark):
    rows = spark.createDataFrame([(1.0, 5), (2.0, 5), (6.0, 5)], "a double, b int")
    scaler = fit_scaler(rows, ["a", "b"])
    stats = {r.column: (r["mean"], r["std"]) for r in scaler.collect()}
    assert stats["a"] == (3.0, pytest.approx(np.std([1, 2, 6])))
    assert stats["b"] == (5.0, 1.0)
    scaled = apply_scaler(rows, scaler).collect()
    assert [r.b_scaled for r in scaled] == [0.0] * 3
    assert sum(r.a_scaled for r in scaled) == pytest.approx(0)


def slow_metrics(scores, labels):
    called = [s >= 0.5 for s in scores]
    tp = sum(c and y for c, y in zip(called, labels))
    fp = sum(c and not y for c, y in zip(called, labels))
    fn = sum((not c) and y for c, y in zip(called, labels))
    accuracy = sum(c == bool(y) for c, y in zip(called, labels)) / len(labels)
    f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for cut in sorted(set(scores), reverse=True):
        above = [y for s, y in zip(scores, labels) if s >= cut]
        recall = sum(above) / len(pos)
        ap += (recall - last) * sum(above) / len(above)
        last = recall
    return accuracy, f1, auc, ap


@pytest.mark.parametrize("ranges, levels", [(1, 5), (7, 5), (7, 1000), (40, 30)])
def test_metrics_equal_the_definitions(spark, ranges, levels):
    rng = np.random.default_rng(ranges + levels)
    scores = (rng.integers(0, levels, 200) / levels).tolist()
    labels = (rng.random(200) < 0.3).astype(int).tolist()
    frame = spark.createDataFrame(list(zip(scores, labels)), "score double, y int").repartition(5)
    row = binary_metrics(frame, ranges=ranges).first()
    assert (row.accuracy, row.f1, row.roc_auc, row.average_precision) == pytest.approx(slow_metrics(scores, labels))
    assert row.n_rows == 200


def test_metric_edges(spark):
    row = binary_metrics(spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, y int")).first()
    assert (row.accuracy, row.f1, row.roc_auc, row.average_precision) == (1.0, 0.0, None, None)
    row = binary_metrics(spark.createDataFrame([(0.5, 1), (0.4, 0)], "score double, y int")).first()
    assert (row.accuracy, row.f1, row.roc_auc, row.average_precision) == (1.0, 1.0, 1.0, 1.0)
    with pytest.raises(Exception, match="target must be 0 or 1"):
        binary_metrics(spark.createDataFrame([(0.5, 2)], "score double, y int")).first()


def test_metric_gap_and_profile(spark):
    scores = spark.createDataFrame(
        [("leaky", 1.0, 0.9, 1.0, 0.8), ("clean", 0.7, 0.5, 0.75, 0.6), ("other", 0.0, 0.0, 0.0, 0.0)],
        "key string, accuracy double, f1 double, roc_auc double, average_precision double",
    )
    assert list(metric_gap(scores).first()) == pytest.approx([0.3, 0.4, 0.25, 0.2])
    rows = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("c", 1)], "g string, y int")
    assert tuple(dataset_profile(rows, "g", "y").first()) == (4, 3, 0.75)


def test_fingerprint(spark, table):
    def of(frame):
        return table_fingerprint(frame).first().fingerprint

    lines = table("lineitem")
    base = of(lines)
    assert len(base) == 16
    assert of(lines.repartition(13).orderBy("l_tax")) == base
    assert of(lines.unionByName(lines.limit(1))) != base
    assert of(lines.withColumnRenamed("l_tax", "tax")) != base
    assert of(lines.withColumn("l_tax", F.when(F.col("l_orderkey") == 1, 9.0).otherwise(F.col("l_tax")))) != base
    pairs = [[("ab", "c")], [("a", "bc")], [("a\0", "b")], [("a", "\0b")], [(None, "N")], [("N", None)], [("", "")]]
    assert len({of(spark.createDataFrame(p, "a string, b string")) for p in pairs}) == len(pairs)


def test_salted_lookup_equals_plain(spark):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("k")
    ).repartition(6)
    names = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k < 40").withColumn("v", F.col("k") * 2)
    for how in ("left", "inner", "left_semi"):
        plain = lookup_join(rows, names, ["k"], how)
        salted = lookup_join(rows, names, ["k"], how, "n", 3000, salt_min_rows=0)
        assert set(plain.columns) == set(salted.columns)
        assert sorted(map(tuple, salted.select(plain.columns).collect()), key=str) == sorted(
            map(tuple, plain.collect()), key=str
        )
