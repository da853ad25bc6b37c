"""The near search equals brute force, whatever path it takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscan import SearchLimits, SplitPair, audit_split
from leakscan.operators import match
from leakscan.scratch import materialize

PATHS = {
    "plain": SearchLimits(),
    "guarded": SearchLimits(chunk_rows=16),
    "chunked": SearchLimits(chunk_rows=2),
    "levels": SearchLimits(chunk_rows=4, min_pair_budget=1, pairs_per_vector=0, max_levels=4),
    "shuffled chunks": SearchLimits(chunk_rows=2, broadcast_rows=0),
    "salted": SearchLimits(salt_min_rows=0),
}


def brute_force(train, test, atol):
    """Nearest train row inside the tolerance, lowest id on ties, one block per category."""
    found = {}
    for test_id, values, category in test:
        best = min(
            ((max(abs(a - b) for a, b in zip(values, other, strict=True)), train_id)
             for train_id, other, block in train if block == category),
            default=None,
        )
        if best is not None and best[0] <= atol:
            found[test_id] = best
    return found


def draw(rng, n, width, cluster):
    """Values on cell edges, clustered, negative, huge and zero."""
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4:
            values = rng.integers(-3, 4, width) * (4 * cluster or 1.0)
        elif kind < 0.8:
            values = rng.normal(0, 3 * cluster or 1.0, width)
        elif kind < 0.9:
            values = np.full(width, rng.choice([1e12, -1e12, 0.0, -0.0])) + rng.normal(0, cluster or 1.0, width)
        else:
            values = np.zeros(width)
        rows.append((i, [float(v) for v in values], str(rng.choice(["a", "b"]))))
    return rows


def frame(spark, rows, width):
    schema = "id bigint, c string, " + ", ".join(f"x{j} double" for j in range(width))
    return spark.createDataFrame([(i, c, *v) for i, v, c in rows], schema)


@pytest.mark.parametrize("width, atol, path", [
    (1, 0.5, "plain"), (2, 0.0, "plain"), (3, 0.001, "guarded"), (2, 0.5, "chunked"), (1, 2.0, "levels"),
    (4, 0.5, "levels"), (2, 2.0, "shuffled chunks"), (2, 0.5, "salted"),
])
def test_search_equals_brute_force(spark, monkeypatch, width, atol, path):
    rng = np.random.default_rng(width * 100 + int(atol * 10))
    train, test = draw(rng, 120, width, atol), draw(rng, 60, width, atol)
    # One vector holds a third of each side.
    train += [(1000 + i, train[0][1], train[0][2]) for i in range(60)]
    test += [(1000 + i, test[0][1], test[0][2]) for i in range(30)]
    expected = brute_force(train, test, atol)
    steps = []
    monkeypatch.setattr(match, "materialize", lambda df, name: steps.append(name) or materialize(df, name))
    features = [f"x{j}" for j in range(width)] + ["c"]
    audit = audit_split(
        SplitPair(frame(spark, train, width), frame(spark, test, width).repartition(5)), features,
        near_atol=atol, exact_atol=0.0, id_columns=["id"], limits=PATHS[path],
    )
    rows = audit.row_matches.collect()
    assert {r.test_id: (r.distance, r.train_id) for r in rows} == expected
    assert len(rows) == len(expected)
    summary = audit.summary.first()
    assert summary.exact_duplicate_rows == sum(d == 0 for d, _ in expected.values())
    assert summary.near_duplicate_rows == sum(d > 0 for d, _ in expected.values())
    assert "chunk" not in path or "hot_cells" in steps
    assert (steps.count("near") > 1) == (path == "levels")


@pytest.mark.parametrize("path", sorted(PATHS))
@pytest.mark.parametrize("ids", ["repeated", "null"])
def test_ids_decide_nothing(spark, path, ids):
    """Counts are the same whether ids are unique, repeated or missing."""
    rng = np.random.default_rng(11)
    train, test = draw(rng, 120, 2, 0.5), draw(rng, 60, 2, 0.5)
    expected = brute_force(train, test, 0.5)
    changed = F.lit(None).cast("bigint") if ids == "null" else F.expr("id div 2")
    pair = SplitPair(frame(spark, train, 2).withColumn("id", changed), frame(spark, test, 2).withColumn("id", changed))
    summary = audit_split(pair, ["x0", "x1", "c"], near_atol=0.5, exact_atol=0.0, id_columns=["id"], limits=PATHS[path]).summary.first()
    assert summary.exact_duplicate_rows == sum(d == 0 for d, _ in expected.values())
    assert summary.near_duplicate_rows == sum(d > 0 for d, _ in expected.values())


def test_result_is_free_of_partitioning(spark):
    rng = np.random.default_rng(5)
    train, test = draw(rng, 150, 2, 0.5), draw(rng, 80, 2, 0.5)
    results = []
    for parts, tasks in ((8, 1), (3, 7)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        pair = SplitPair(frame(spark, train[::-1], 2).repartition(tasks), frame(spark, test, 2).repartition(tasks))
        found = audit_split(pair, ["x0", "x1", "c"], near_atol=0.5, id_columns=["id"], limits=PATHS["levels"])
        results.append(sorted(map(tuple, found.row_matches.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] and results[0]


def test_search_joins_have_keys(spark, table):
    lines = table("lineitem").withColumn(
        "split", F.when(F.col("l_shipdate") < "2000-01-01", "train").otherwise("test")
    )
    from leakscan import split_pair

    audit = audit_split(split_pair(lines), ["l_quantity", "l_tax", "l_returnflag"], near_atol=0.01)
    for frame_ in (audit.row_matches, audit.summary):
        plan = frame_._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
