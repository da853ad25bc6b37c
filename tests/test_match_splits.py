"""Several splits audited in one pass against one audit per split."""

import random

import pytest
from pyspark.sql import functions as F

from leakscan import SearchLimits, audit_both_splits, audit_split, audit_splits, split_pair
from leakscan.errors import InputError

SPLITS = {"first": "s1", "second": "s 2", "third": "s3"}


def visits(spark, seed, n=400, spread=3.0):
    random.seed(seed)
    rows = []
    for i in range(n):
        x, y = round(random.gauss(0, spread), 2), random.choice([0.0, 0.5, 1.0])
        sides = [random.choice(["train", "test"]) for _ in SPLITS]
        rows.append((i, x, y, random.choice("ab"), random.choice([None, "g1", "g2", f"p{i % 50}"]), *sides))
    return spark.createDataFrame(rows, "id int, x double, y double, kind string, grp string, s1 string, `s 2` string, s3 string").repartition(3)


def alone(table, column, *args, **options):
    others = [c for c in SPLITS.values() if c != column]
    return audit_split(split_pair(table.drop(*others), column), *args, **options)


def rows_of(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize(("features", "near", "ids", "limits"), [
    (["x", "y", "kind"], 0.05, ["id"], SearchLimits()),
    (["x", "y", "kind"], 0.05, [], SearchLimits()),
    (["x", "kind"], 0.4, ["id", "kind"], SearchLimits(pairs_per_vector=10**6, min_pair_budget=1, chunk_rows=4)),
    (["x", "kind"], 0.4, ["id"], SearchLimits(pairs_per_vector=1, min_pair_budget=1, chunk_rows=8)),
    (["x", "y"], 0.0, ["id"], SearchLimits()),
    (["kind", "y"], 0.01, ["id"], SearchLimits()),
])
def test_same_as_one_audit_each(spark, features, near, ids, limits):
    table = visits(spark, 7).cache()
    options = {"near_atol": near, "exact_atol": 0.0, "id_columns": ids, "limits": limits}
    together = audit_splits(table, features, SPLITS, "grp", **options)
    for name, column in SPLITS.items():
        one = alone(table, column, features, "grp", **options)
        assert rows_of(together[name].summary) == rows_of(one.summary)
        assert rows_of(together[name].row_matches) == rows_of(one.row_matches)
        assert rows_of(together[name].group_overlap) == rows_of(one.group_overlap)


def test_categorical_features_and_no_group(spark):
    table = visits(spark, 8)
    together = audit_splits(table, ["kind"], SPLITS, id_columns=["id"])
    for name, column in SPLITS.items():
        one = alone(table, column, ["kind"], id_columns=["id"])
        assert rows_of(together[name].summary) == rows_of(one.summary)
        assert rows_of(together[name].row_matches) == rows_of(one.row_matches)


def test_one_scan_for_all_splits(spark, tmp_path):
    visits(spark, 9).write.parquet(str(tmp_path / "visits"))
    table = spark.read.parquet(str(tmp_path / "visits"))
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        reads.add(1)
        return x

    watched = table.withColumn("x", seen.asNondeterministic()("x"))
    audit_both_splits(watched, ["x", "kind"], "grp", SPLITS, near_atol=0.05, id_columns=["id"]).collect()
    assert reads.value == table.count()


def test_bad_input_is_refused(spark):
    table = visits(spark, 10)
    with pytest.raises(InputError, match="at least one row"):
        audit_splits(table.withColumn("s3", F.lit("train")), ["x"], SPLITS)
    with pytest.raises(InputError, match="missing"):
        audit_splits(table.withColumn("x", F.when(F.col("id") != 5, F.col("x"))), ["x"], SPLITS)
    with pytest.raises(InputError, match="finite"):
        audit_splits(table.withColumn("x", F.when(F.col("id") != 5, F.col("x")).otherwise(float("inf"))), ["x"], SPLITS)
    with pytest.raises(InputError, match="not in"):
        audit_splits(table, ["x", "s1"], SPLITS)
    with pytest.raises(InputError, match="split column"):
        audit_splits(table, ["x"], {"a": "absent"})
    with pytest.raises(InputError, match="1 to"):
        audit_splits(table, ["x"], {})
    with pytest.raises(Exception, match="unknown value"):
        audit_splits(table.withColumn("s1", F.lit("dev")), ["x"], SPLITS)
