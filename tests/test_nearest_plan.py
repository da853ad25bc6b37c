"""The near search takes in candidate pairs by hash aggregates: a task's memory does not grow with the pairs."""

import re

import pytest

from leakscan import SplitPair, audit_split, scratch
from leakscan.operators import match, match_splits


def vectors(spark, ids):
    rows = spark.range(60).selectExpr("CAST(id AS double) / 4 AS _n0", "'a' AS _c0", f"{ids} AS _id", "id")
    train = rows.where("id % 3 > 0").selectExpr("_n0", "_c0", "_id AS train_id")
    return train, rows.where("id % 3 = 0").selectExpr("_n0", "_c0", "_id AS test_id", "1L AS n_test")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_pairs_are_sorted(spark):
    train, test = vectors(spark, "id")
    cells = match._Grid(2.0, (0,), (15.0,))
    nearest = match._nearest(train, test, cells, ["_c0"], ["_n0", "_c0"])
    assert "SortAggregate" not in plan_of(nearest)
    assert {(r.test_id, r.train_id, r.distance) for r in nearest.collect()} == {(i, max(i - 1, 1), 0.25) for i in range(0, 60, 3)}


def test_no_pairs_of_several_splits_are_sorted(spark):
    train, test = vectors(spark, "id")
    train = train.selectExpr("_n0", "_c0", "if(train_id % 2 = 0, 1L, 3L) AS _has", "train_id AS train_id_0", "if(train_id % 2 = 0, NULL, train_id) AS train_id_1")
    test = test.selectExpr("_n0", "_c0", "if(test_id = 30, 2L, 3L) AS _wants", "test_id AS test_id_0", "n_test AS n_test_0", "test_id AS test_id_1", "n_test AS n_test_1")
    found = match_splits._nearest_of_splits(train, test, match._Grid(0.25, (0,), (15.0,)), ["_c0"], ["_n0", "_c0"], 2, None)
    assert "SortAggregate" not in plan_of(found)
    rows = {r.test_id_0: r for r in found.collect()}
    odd = {i: min((j for j in (i - 1, i + 1) if j > 0 and j % 2), default=None) for i in range(0, 60, 3)}
    for i, r in rows.items():
        assert (r._best_0 is None) == (i == 30)
        assert i == 30 or tuple(r._best_0) == (0.25, max(i - 1, 1))
        assert (None if r._best_1 is None else r._best_1.train_id) == odd[i]


@pytest.mark.parametrize("missing", [4, 2])
def test_a_missing_id_stays_the_lowest_of_equally_near_ones(spark, missing):
    train = spark.createDataFrame([(None if x == missing else int(x), float(x)) for x in (2, 4)], "i bigint, x double")
    test = spark.createDataFrame([(9, 3.0)], "i bigint, x double")
    found = audit_split(SplitPair(train, test), ["x"], near_atol=1.0, id_columns=["i"]).row_matches.first()
    assert (found.test_id, found.train_id, found.distance) == (9, None, 1.0)


def test_meetings_of_chunks_are_not_put_into_one_task(spark):
    rows = spark.range(240).selectExpr("id", "CAST(hash(id) % 100 AS double) / 100 AS x", "CAST(hash(id, 1) % 100 AS double) / 100 AS y")
    pair = SplitPair(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"))
    tasks = []

    def recorded(frame, name, *rest):
        if name == "near":
            plan = frame._jdf.queryExecution().optimizedPlan().toString()
            tasks.extend(int(x) for x in re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan))
        return scratch.materialize(frame, name, *rest)

    limits = match.SearchLimits(pairs_per_vector=1, min_pair_budget=1, chunk_rows=8, max_levels=1)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(match, "materialize", recorded)
        found = audit_split(pair, ["x", "y"], near_atol=0.4, id_columns=["id"], limits=limits).row_matches.collect()
    assert len(tasks) == 4 and min(tasks) > 4  # both sides of both passes; 4 is spark.sql.shuffle.partitions
    all_ = rows.collect()
    train = [r for r in all_ if r.id % 3]
    least = {q.id: min((max(abs(q.x - t.x), abs(q.y - t.y)), t.id) for t in train) for q in all_ if q.id % 3 == 0}
    assert {r.test_id: (r.distance, r.train_id) for r in found} == {i: v for i, v in least.items() if v[0] <= 0.4}


def test_the_second_pass_stops_at_the_first_column_that_is_too_far(spark):
    train, test = vectors(spark, "id")
    nearest = match._nearest(train, test, match._Grid(2.0, (0,), (15.0,)), ["_c0"], ["_n0", "_c0"])
    assert plan_of(nearest).count("<= distance") == 1 and "= distance#" not in plan_of(nearest).replace("<= distance#", "")
