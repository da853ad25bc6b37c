"""Planted truth, files, the strict gate and feature resolution."""

import pytest
from pyspark.sql import functions as F

from leakscan import (
    InputError,
    LeakageFound,
    SplitPair,
    audit_both_splits,
    audit_job,
    audit_split,
    check_expectations,
    expand_vectors,
    group_preview,
    group_split,
    plant_leaks,
    recall,
    resolve_features,
    rows_in_overlap,
    split_pair,
    stratified_row_split,
)
from leakscan import scratch

# How many leaks each case plants.
EXACT, NEAR, SHARED = 11, 9, ("SHARE0", "SHARE1", "SHARE2", "SHARE3", "SHARE4")
FEATURES = ["x0", "x1", "x2", "site"]
CASES = {
    # name: train rows, test rows, exact copies, near copies, shared ids
    "exact_row_copies": (40, 20, EXACT, 0, 0),
    "near_row_copies": (40, 20, 0, NEAR, 0),
    "shared_patient_ids": (26, 26, 0, 0, 5),
    "all_three_together": (45, 16, EXACT, NEAR, 5),
    "clean_separated_rows": (30, 24, 0, 0, 0),
}


def side(spark, prefix, n, centre):
    """Scattered rows around a centre, no two alike."""
    return spark.range(n).select(
        F.concat(F.lit(prefix), "id").alias("visit_id"),
        F.concat(F.lit(prefix), F.lpad("id", 3, "0")).alias("patient_id"),
        F.when(F.hash("id") % 2 == 0, "east").otherwise("west").alias("site"),
        *[(F.lit(centre) + F.sin((F.col("id") + 1) * (k + 1.7)) * 1.5).alias(f"x{k}") for k in range(3)],
    )


def planted_case(spark, name):
    n_train, n_test, exact, near, shared = CASES[name]
    train, test = side(spark, "TR", n_train, 0.0), side(spark, "TE", n_test, 20.0)
    if shared:
        renamed = {f"TR{i:03d}": label for i, label in enumerate(SHARED)}
        owner = F.coalesce(*[F.when(F.col("patient_id") == k, v) for k, v in renamed.items()], "patient_id")
        train = train.withColumn("patient_id", owner)
        owner = F.coalesce(
            *[F.when(F.col("patient_id") == k.replace("TR", "TE"), v) for k, v in renamed.items()], "patient_id"
        )
        test = test.withColumn("patient_id", owner)
    return plant_leaks(SplitPair(train, test), "visit_id", FEATURES, "patient_id", exact, near, prefix=name)


@pytest.mark.parametrize("name", CASES)
def test_planted_counts_are_found(spark, name):
    _, _, exact, near, shared = CASES[name]
    planted = planted_case(spark, name)
    audit = audit_split(planted.pair, FEATURES, "patient_id", id_columns=["visit_id"])
    observed = audit.summary.select(F.lit(name).alias("name"), "*").join(
        audit.group_overlap.agg(F.sort_array(F.collect_list("label")).alias("group_labels"))
    )
    wanted = list(SHARED[:shared])
    expected = spark.createDataFrame(
        [(name, exact, near, wanted)], "name string, expect_exact int, expect_near int, expect_groups array<string>"
    )
    assert check_expectations(observed, expected).first().passed
    counts = expected.withColumn("expect_groups", F.size("expect_groups"))
    assert check_expectations(observed, counts).first().passed
    assert not check_expectations(observed, counts.withColumn("expect_near", F.lit(77))).first().passed
    assert audit.has_leakage() == bool(exact or near or shared)
    for r in recall(planted.truth, audit.row_matches).collect():
        assert r.planted == r.found == r.found_as_planted
    truth = {(r.test_id, r.source_id) for r in planted.truth.collect()}
    assert truth == {(r.test_id, r.train_id) for r in audit.row_matches.collect()}


def test_repeated_measures_on_one_side_are_clean(spark):
    train, test = side(spark, "A", 24, 0.0), side(spark, "B", 18, 15.0)
    thirds = F.concat(F.substring("patient_id", 1, 1), (F.substring("patient_id", 2, 3).cast("int") % 8).cast("string"))
    pair = SplitPair(train.withColumn("patient_id", thirds), test.withColumn("patient_id", thirds))
    assert audit_split(pair, FEATURES, "patient_id").has_leakage() is False


def test_planting_integer_ids_and_groups(spark, table):
    orders = group_split(table("orders"), "o_custkey").withColumn("o_totalprice", F.col("o_totalprice"))
    planted = plant_leaks(split_pair(orders), "o_orderkey", ["o_totalprice", "o_orderstatus"], "o_custkey", 6, 4, 3)
    audit = audit_split(planted.pair, ["o_totalprice", "o_orderstatus"], "o_custkey", id_columns=["o_orderkey"])
    assert {r.kind: (r.planted, r.found) for r in recall(planted.truth, audit.row_matches).collect()} == {
        "exact": (6, 6), "near": (4, 4)
    }
    assert audit.group_overlap.count() == 3
    highest = orders.agg(F.max("o_orderkey")).first()[0]
    assert planted.truth.agg(F.min("test_id")).first()[0] == highest + 1


def test_csv_job_strict_gate_and_findings(spark, tmp_path):
    def csv(name, rows):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, "dose double, ward string, outcome int").coalesce(1).write.csv(path, header=True)
        return path

    train = csv("train", [(2.5, "north", 1), (4.75, "east", 0), (6.0, "south", 1)])
    leaked = csv("leaked", [(11.25, "south", 0), (13.5, "west", 1)])
    clean = csv("clean", [(12.0, "west", 0), (14.5, "hill", 0), (17.0, "west", 1)])
    common = {"group": "ward", "target": "outcome"}
    out = str(tmp_path / "deep" / "er" / "findings")
    with pytest.raises(LeakageFound, match="1 shared groups") as caught:
        audit_job(spark, train, leaked, output=out, strict=True, **common)
    assert caught.value.summary["n_overlapping_groups"] == 1
    written = spark.read.parquet(f"{out}/summary").first()
    assert written.has_leakage and written.feature_columns == ["dose"]
    assert [r.label for r in spark.read.parquet(f"{out}/group_overlap").collect()] == ["south"]
    assert spark.read.parquet(f"{out}/row_matches").count() == 0
    assert audit_job(spark, train, clean, strict=True, **common).has_leakage() is False
    with pytest.raises(Exception, match="(?i)path"):
        audit_job(spark, str(tmp_path / "absent"), clean)
    with pytest.raises(InputError, match="target"):
        audit_job(spark, train, clean, target="misspelt")


def test_csv_schema_loss_and_explicit_subset(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0)], "x double, z double").write.csv(str(tmp_path / "a"), header=True)
    spark.createDataFrame([(1.0,)], "x double").write.csv(str(tmp_path / "b"), header=True)
    paths = str(tmp_path / "a"), str(tmp_path / "b")
    with pytest.raises(InputError, match="missing from test: z"):
        audit_job(spark, *paths)
    with pytest.raises(InputError, match="extra in test: z"):
        audit_job(spark, *paths[::-1])
    assert audit_job(spark, *paths, features=" x ,").summary.first().exact_duplicate_rows == 1
    assert audit_job(spark, *paths, features="x", schema="x double").has_leakage()
    with pytest.raises(InputError, match="does not name"):
        audit_job(spark, *paths, features=" , ")


def test_default_features_keep_train_order(spark):
    train = spark.createDataFrame([(1, 2, 3, 4)], "b int, g int, a int, y int")
    pair = SplitPair(train, train.select("a", "b", "y", "g"))
    assert resolve_features(pair, None, "g", "y") == ["b", "a"]
    with pytest.raises(InputError, match="no feature"):
        resolve_features(SplitPair(train.select("g", "y"), train.select("g", "y")), None, "g", "y")


def test_both_splits_preview_and_listed_rows(spark, table):
    orders = stratified_row_split(table("orders"), "o_orderkey", "o_orderstatus", into="by_row")
    orders = group_split(orders, "o_custkey", into="by_group")
    kinds = {"row": "by_row", "group": "by_group"}
    rows = {r.split_kind: r for r in audit_both_splits(
        orders, ["o_totalprice", "o_orderstatus"], "o_custkey", kinds, id_columns=["o_orderkey"]
    ).collect()}
    assert rows["row"].n_overlapping_groups > 0 and rows["group"].n_overlapping_groups == 0

    audit = audit_split(split_pair(orders, "by_row"), ["o_totalprice"], "o_custkey", id_columns=["o_orderkey"])
    labels = sorted(r.label for r in audit.group_overlap.collect())
    preview = audit.preview().collect()
    assert [r.label for r in preview] == labels[:8]
    assert {r.n_more for r in preview} == {len(labels) - 8}
    assert group_preview(audit.group_overlap.limit(0)).collect() == []
    for which, n in (("train", rows["row"].train_rows_with_overlapping_group),
                     ("test", rows["row"].test_rows_with_overlapping_group)):
        for salt in (0, 10**9):
            assert rows_in_overlap(split_pair(orders, "by_row"), "o_custkey", which, salt).count() == n


def test_expanded_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.5])], "id int, v array<float>")
    wide = expand_vectors(frame, "v", 2)
    assert wide.columns == ["id", "v_0", "v_1"]
    pair = SplitPair(wide.where("id = 1"), wide.where("id = 2"))
    found = audit_split(pair, ["v_0", "v_1"], near_atol=0.5, id_columns=["id"]).row_matches.first()
    assert (found.distance, found.kind) == (0.5, "near")
    with pytest.raises(Exception, match="3 elements"):
        expand_vectors(frame, "v", 3).collect()


def test_scratch_tables_follow_the_session_and_can_be_released(spark, tmp_path, monkeypatch):
    folder = tmp_path / "shared"
    monkeypatch.setattr(scratch, "scratch_root", lambda _: str(folder))
    first, second = (scratch.materialize(spark.range(5), name) for name in ("first", "second"))
    assert first.count() == 5
    assert len(list((folder / "leakscan").iterdir())) == 2
    scratch.discard(first, spark.range(1))
    assert len(list((folder / "leakscan").iterdir())) == 1
    assert second.count() == 5
    scratch.discard(second)
    assert not list((folder / "leakscan").iterdir())


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        conf = {}

        def getCheckpointDir(self):
            return None

        def get(self, name, default):
            return self.conf.get(name, default)

    class Session:
        conf = sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Session())
    Context.conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert scratch.scratch_root(Session()) == "hdfs:///shared"


def test_missing_tokens_in_csv(spark, tmp_path):
    from leakscan import audit_split, read_pair

    (tmp_path / "a.csv").write_text("k,x,note,when\n1,1.0,NA,2024-01-05 10:00:00\n2,2.0,ok,n/a\n")
    (tmp_path / "b.csv").write_text("k,x,note,when\n3,1.0005,null,\n4,9.0,fine,2024-01-06 10:00:00\n")
    (tmp_path / "c.csv").write_text("k,x,note,when\n3,NA,null,\n4,9.0,fine,\n")
    pair = read_pair(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert dict(pair.train.dtypes) == {"k": "int", "x": "double", "note": "string", "when": "timestamp"}
    assert [r.note for r in pair.train.orderBy("k").collect()] == [None, "ok"]
    assert audit_split(pair, ["x"], id_columns=["k"]).summary.first().near_duplicate_rows == 1
    with pytest.raises(InputError, match="missing"):
        audit_split(read_pair(spark, str(tmp_path / "a.csv"), str(tmp_path / "c.csv")), ["x"])


def test_unknown_split_values_stop_the_audit(spark):
    from leakscan import audit_split, split_pair

    rows = spark.createDataFrame([(1.0, "train"), (1.0, "test"), (2.0, "valid"), (3.0, None)], "x double, split string")
    with pytest.raises(Exception, match="unknown value in split column"):
        audit_split(split_pair(rows), ["x"]).summary.first()
    summary = audit_split(split_pair(rows, ignored_values=["valid", None]), ["x"]).summary.first()
    assert (summary.n_train, summary.n_test, summary.exact_duplicate_rows) == (1, 1, 1)


def test_planting_again_gives_new_ids_and_too_few_rows_are_an_error(spark):
    from leakscan import SplitPair, plant_leaks

    side = lambda name, n: spark.createDataFrame([(f"{name}{i}", f"g{name}{i}", float(i)) for i in range(n)], "id string, g string, x double")
    pair = SplitPair(side("a", 6), side("b", 6))
    once = plant_leaks(pair, "id", ["x"], "g", 2, 1)
    twice = plant_leaks(once.pair, "id", ["x"], "g", 2, 1)
    ids = [r.id for r in twice.pair.test.select("id").collect()]
    assert len(ids) == len(set(ids)) == 12
    with pytest.raises(InputError, match="can be planted"):
        plant_leaks(pair, "id", ["x"], "g", 7, 0)


def test_fingerprint_is_free_of_the_time_zone(spark):
    from leakscan import table_fingerprint

    rows = spark.createDataFrame([(1, "2024-05-06T07:08:09Z")], "k int, t string").selectExpr("k", "CAST(t AS timestamp) AS t", "array(CAST(t AS timestamp)) AS l")
    found = []
    for zone in ("Asia/Tokyo", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        found.append(tuple(table_fingerprint(rows).first()))
    assert found[0] == found[1]
