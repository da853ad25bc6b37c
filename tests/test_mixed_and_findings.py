"""JSON columns of mixed types, rows named by their place, findings that are whole or absent."""

import json

import pytest
from pyspark.sql import functions as F

from leakscan import InputError, LeakageFound, SplitPair, audit_job, audit_split, audit_splits, group_overlap, read_findings, read_pair, table_fingerprint, write_findings
from leakscan.functions.variants import typed_variants

VALUES = {
    "7": ("int", "7"), '"7"': ("str", "7"), "7.0": ("float", "7.0"), "7.50": ("float", "7.5"), "7.5": ("float", "7.5"), "7e0": ("float", "7.0"),
    "true": ("bool", "True"), '"True"': ("str", "True"), "false": ("bool", "False"), "null": None, '""': ("str", ""), "-0.0": ("float", "0.0"),
    "9223372036854775807": ("int", "9223372036854775807"), "9223372036854775808": ("int", "9223372036854775808"),
    "-123456789012345678901234567890": ("int", "-123456789012345678901234567890"), '"' + "long " * 5000 + '"': ("str", "long " * 5000),
}


def variants(spark, literals):
    rows = [(i, literal) for i, literal in enumerate(literals)]
    return spark.createDataFrame(rows, "i int, t string").select("i", F.expr("parse_json(t)").alias("v"))


def test_types_of_variant_values(spark):
    got = {r.i: r.v and tuple(r.v) for r in typed_variants(variants(spark, [*VALUES, None])).collect()}
    assert got == dict(enumerate([*VALUES.values(), None]))
    assert typed_variants(variants(spark, [])).collect() == []
    nested = variants(spark, ["[1]", '{"a":1}'])
    assert typed_variants(nested).select("i").count() == 2
    with pytest.raises(Exception, match="(?i)hash"):
        typed_variants(nested).collect()


def test_groups_and_features_of_mixed_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k":7,"x":1}\n{"k":"7","x":2}\n{"k":true,"x":3}\n{"k":null,"x":4}\n{"x":5}\n')
    (tmp_path / "b.json").write_text('{"k":"7","x":2}\n{"k":7.0,"x":1}\n{"k":true,"x":9}\n{"k":null,"x":4}\n')
    pair = read_pair(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"), "json", "k variant, x double")
    assert {r.label: (r.n_train, r.n_test) for r in group_overlap(pair, "k").collect()} == {"7": (1, 1), "bool:True": (1, 1)}
    whole = SplitPair(pair.train.where("k IS NOT NULL"), pair.test.where("k IS NOT NULL"))
    assert audit_split(whole, ["k", "x"], near_atol=0.1).summary.first().exact_duplicate_rows == 1
    with pytest.raises(InputError, match="missing values"):
        audit_split(pair, ["k", "x"], near_atol=0.1)
    plain = SplitPair(pair.train, spark.createDataFrame([(7,), (8,)], "k int"))
    assert [r.label for r in group_overlap(plain, "k").collect()] == ["int:7"]


def test_several_splits_of_variants(spark):
    table = variants(spark, ["1", '"1"', "1", '"1"']).selectExpr("v", "1.0 AS x", "if(i < 2, 'train', 'test') AS a", "if(i % 2 = 0, 'train', 'test') AS b")
    found = audit_splits(table, ["v", "x"], {"a": "a", "b": "b"}, "v", near_atol=0.1)
    assert {name: (row.exact_duplicate_rows, row.n_overlapping_groups) for name in found for row in [found[name].summary.first()]} == {"a": (2, 2), "b": (0, 0)}


def test_fingerprint_of_variants(spark):
    marks = [table_fingerprint(variants(spark, [t])).first()[0] for t in ("7", '"7"', "null", None, '{"a":1,"b":2}', '{"b":2,"a":1}')]
    assert len(set(marks)) == 5 and marks[4] == marks[5]


def test_rows_named_by_place(spark, tmp_path):
    paths = [str(tmp_path / side) for side in ("train", "test")]
    spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "x double").coalesce(1).write.parquet(paths[0])
    spark.createDataFrame([(2.0,), (5.0,), (1.0,), (2.0,)], "x double").coalesce(1).write.parquet(paths[1])
    audit = audit_job(spark, *paths, fmt="parquet", row_ids="place")
    got = {r.test_id.row: r.train_id.row for r in audit.row_matches.collect()}
    assert got == {0: 1, 2: 0, 3: 1}
    assert all("/test/" in r.test_id.file and "/train/" in r.train_id.file for r in audit.row_matches.collect())
    with pytest.raises(InputError, match="already"):
        read_pair(spark, *paths, "parquet", row_ids="x")
    with pytest.raises(InputError, match="parquet"):
        read_pair(spark, *paths, "csv", row_ids="place")


def small_audit(spark, leak=True):
    train = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "i int, g string, x double")
    test = spark.createDataFrame([(3, "a" if leak else "c", 1.0 if leak else 9.0), (4, "d", 7.0)], "i int, g string, x double")
    return audit_split(SplitPair(train, test), ["x"], "g", id_columns=["i"])


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_findings_come_back(spark, tmp_path, fmt):
    path = str(tmp_path / "deep" / "findings")
    audit = small_audit(spark)
    written = write_findings(audit, path, fmt=fmt)
    assert written.summary == audit.summary.first()
    found = read_findings(spark, path)
    for name in ("summary", "row_matches", "group_overlap"):
        assert getattr(found, name).collect() == getattr(audit, name).collect()
        assert written.parts[name]["fingerprint"] == table_fingerprint(getattr(audit, name)).first()[0]
    assert [p.name for p in (tmp_path / "deep").iterdir() if "staging" in p.name] == []


def test_modes_and_empty_findings(spark, tmp_path):
    path = str(tmp_path / "findings")
    assert write_findings(small_audit(spark, False), path).parts["row_matches"]["rows"] == 0
    assert read_findings(spark, path).group_overlap.collect() == []
    with pytest.raises(InputError, match="exists"):
        write_findings(small_audit(spark), path)
    assert write_findings(small_audit(spark), path, "ignore") is None
    assert write_findings(small_audit(spark), path, "overwrite").summary.has_leakage
    assert read_findings(spark, path).row_matches.count() == 1
    with pytest.raises(InputError, match="mode"):
        write_findings(small_audit(spark), path, "append")
    ungrouped = audit_split(SplitPair(*[spark.createDataFrame([(1.0,)], "x double")] * 2), ["x"])
    write_findings(ungrouped, path, "overwrite")
    assert read_findings(spark, path).group_overlap.count() == 0


def test_a_failed_write_leaves_nothing_and_a_changed_one_is_found(spark, tmp_path):
    path = tmp_path / "findings"
    audit = small_audit(spark)
    broken = type("Broken", (), {
        "summary": audit.summary, "row_matches": audit.row_matches.withColumn("kind", F.raise_error(F.lit("lost"))), "group_overlap": audit.group_overlap,
    })
    with pytest.raises(Exception, match="lost"):
        write_findings(broken, str(path))
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(InputError, match="no whole findings"):
        read_findings(spark, str(path))
    write_findings(audit, str(path))
    audit.group_overlap.write.mode("append").parquet(str(path / "group_overlap"))
    with pytest.raises(InputError, match="not what was written"):
        read_findings(spark, str(path))
    assert read_findings(spark, str(path), verify=False).group_overlap.count() == 2
    assert json.loads((path / "_findings.json").read_text())["parts"]["group_overlap"]["rows"] == 1


def test_strict_job_needs_no_second_summary(spark, tmp_path):
    paths = [str(tmp_path / side) for side in ("train", "test")]
    spark.createDataFrame([(1.0,)], "x double").write.parquet(paths[0])
    spark.createDataFrame([(1.0,)], "x double").write.parquet(paths[1])
    with pytest.raises(LeakageFound):
        audit_job(spark, *paths, fmt="parquet", output=str(tmp_path / "out"), strict=True)
    assert read_findings(spark, str(tmp_path / "out")).summary.first().has_leakage
