"""Places in a total order, and rows that break the rules."""

import random

import pytest
from pyspark.sql import functions as F

from leakscan import InputError, SplitPair, rule_violations, violation_samples, with_position
from leakscan.operators import positions
from leakscan.scratch import materialize


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_positions_are_those_of_a_sorted_list(spark, ranges):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, *range(2, 200)]), rng.choice(["", "a", "b" * 9000]), i) for i in range(700)]
    table = spark.createDataFrame(rows, "k int, t string, i int").repartition(7)
    got = sorted(with_position(table, ["k", "t", "i"], ranges=ranges).collect())
    assert [r.position for r in got] == list(range(700))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert [tuple(r)[1:] for r in got] == sorted(rows, key=key)


def test_positions_with_ties_empty_tables_and_names(spark, monkeypatch):
    written = []
    monkeypatch.setattr(positions, "materialize", lambda *given: written.append(materialize(*given)) or written[-1])
    same = spark.range(500).select(F.lit(1).alias("k"), (F.col("id") % 250).alias("id"))
    got = sorted(with_position(same, ["k"], ranges=8).collect())
    assert [r.position for r in got] == list(range(500))
    assert sorted(r.id for r in got) == sorted([*range(250)] * 2)
    assert len(written[0].groupBy(F.input_file_name()).count().collect()) > 4  # one value of the key doesn't stay in one range
    assert with_position(same.limit(0), ["k"]).collect() == []
    with pytest.raises(InputError, match="taken"):
        with_position(same.withColumn("position", F.lit(1)), ["k"])


SCHEMA = "id long, x double, n decimal(5,2), c string, `odd name` boolean"
ROWS = [
    (1, 1.0, None, "a", True), (2, float("nan"), None, None, None), (3, float("inf"), None, "", False),
    (4, float("-inf"), None, "c" * 20_000, True), (5, None, None, None, True), (5, None, None, None, True), (None, None, None, "a", True),
]


def broken(rows, side):
    out = []
    for i, x, _, c, odd in rows:
        out += [(side, i, "x", "missing")] * (x is None or x != x) + [(side, i, "x", "nonfinite")] * (x in (float("inf"), float("-inf")))
        out += [(side, i, "c", "missing")] * (c is None) + [(side, i, "odd name", "missing")] * (odd is None)
    return out


def test_violations_and_samples(spark):
    train, test = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(ROWS[:3], SCHEMA)
    pair = SplitPair(train, test)
    found = rule_violations(pair, ["x", "c", "odd name"], ["id"])
    expected = broken(ROWS, "train") + broken(ROWS[:3], "test")
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, expected))
    assert rule_violations(pair, ["n"], ["id"]).count() == 10
    few = {(r.side, r.column, r.rule): r for r in violation_samples(found, ["id"], size=2).collect()}
    assert few["train", "x", "missing"].n_rows == 4 and len(few["train", "x", "missing"]["sample"]) == 2
    assert few["test", "x", "nonfinite"]["sample"] == ["3"]
    assert sum(r.n_rows for r in few.values()) == len(expected)
    whole = SplitPair(train.where("id = 1"), test.limit(0))
    assert violation_samples(rule_violations(whole, ["x", "c"], ["id"]), ["id"]).collect() == []


def test_violations_need_known_columns(spark):
    table = spark.createDataFrame(ROWS, SCHEMA)
    for features, ids in ((["x"], []), (["x"], ["nope"]), (["nope"], ["id"])):
        with pytest.raises(InputError):
            rule_violations(SplitPair(table, table), features, ids)
    named = table.withColumnRenamed("id", "rule")
    with pytest.raises(InputError, match="rule"):
        rule_violations(SplitPair(named, named), ["x"], ["rule"])
