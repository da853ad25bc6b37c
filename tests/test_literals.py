"""Column types of CSV files, found over both sides."""

import pytest

from leakscan import audit_split, read_pair
from leakscan.sources.literals import INTEGER, REAL, TEXT, TIME, TRUTH, WIDE, as_typed, column_type, literal_class, literal_classes


@pytest.fixture
def pair_of(spark, tmp_path):
    def read(train, test, **options):
        for name, rows in (("train", train), ("test", test)):
            (tmp_path / f"{name}.csv").write_text("\n".join(["id,x", *[f"{i},{x}" for i, x in enumerate(rows)]]) + "\n")
        return read_pair(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), **options)

    return read


def kinds(pair):
    assert pair.train.schema["x"] == pair.test.schema["x"]
    return dict(pair.train.dtypes)["x"]


def test_class_of_each_literal(spark):
    wanted = {
        None: 0, "7": INTEGER, "-007": INTEGER, "+1": INTEGER, "1234567890": WIDE, "1" * 18: WIDE, "1" * 19: TEXT, "1.": REAL, ".5": REAL, "-1e9": REAL,
        "1e400": REAL, "inf": REAL, "-Infinity": REAL, "true": TRUTH, "FALSE": TRUTH, "tRUE": TEXT, "yes": TEXT, "t": TEXT, "1D": TEXT, "1F": TEXT,
        "0x1": TEXT, "1_000": TEXT, " 7": TEXT, "7 ": TEXT, "": TEXT, ".": TEXT, "e5": TEXT, "2024-01-05": TEXT, "2024-01-05 10:00:00": TIME,
        "2024-02-30 10:00:00": TEXT, "2024-1-05 10:00:00": TEXT, "2024-01-05T10:00:00": TEXT, "1\n": TEXT, "٣": TEXT, "1" * 19 + ".0": REAL,
    }
    rows = spark.createDataFrame([(text,) for text in wanted], "text string")
    got = {r.text: r.bit for r in rows.select("text", literal_class(rows.text).alias("bit")).collect()}
    assert got == wanted


def test_types_join_over_all_classes():
    every = range(64)
    assert all(column_type(a | b) == column_type(b | a) for a in every for b in every)
    assert [column_type(m) for m in (0, INTEGER, WIDE, REAL, INTEGER | REAL, WIDE | INTEGER, TRUTH, TIME)] == [
        "string", "int", "bigint", "double", "double", "bigint", "boolean", "timestamp"
    ]
    assert {column_type(m) for m in (TEXT, TEXT | INTEGER, TRUTH | INTEGER, TIME | TRUTH, TIME | REAL)} == {"string"}


@pytest.mark.parametrize(("train", "test", "kind", "copies"), [
    (["yes", "no"], ["yes", "maybe"], "string", 1),
    (["2024-01-05", "2024-01-06"], ["2024-01-05", "unknown"], "string", 1),
    (["2024-01-05", "2024-01-06"], ["2024-1-5", "2024-01-06"], "string", 1),
    (["y", "n"], ["yes", "no"], "string", 0),
    (["1D", "2D"], ["1F", "2D"], "string", 1),
    (["true", "false"], ["True", "FALSE"], "boolean", 2),
    (["true", "false"], ["true", "perhaps"], "string", 1),
    (["true", "1"], ["true", "false"], "string", 1),
    (["1", "2"], ["1.0", "3e0"], "double", 1),
    (["1", "2"], ["1", "x"], "string", 1),
    (["007", "8"], ["7", "9"], "int", 1),
    (["1" * 19, "2"], ["1" * 18 + "2", "2"], "string", 1),
    (["3000000000", "5"], ["5", "6"], "bigint", 1),
])
def test_one_type_for_both_sides(pair_of, train, test, kind, copies):
    pair = pair_of(train, test)
    assert kinds(pair) == kind
    assert audit_split(pair, ["x"], id_columns=["id"]).summary.first().exact_duplicate_rows == copies


def test_missing_fields_have_no_class(pair_of):
    assert kinds(pair_of(["NA", "1"], ["", "2.5"])) == "double"
    assert kinds(pair_of(["NA", ""], ["", "NaN"])) == "string"
    assert kinds(pair_of(["NA", "1"], ["2", "3"], missing_tokens=())) == "string"


def test_columns_of_one_side_and_given_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,only a\n1,2\n")
    (tmp_path / "b.csv").write_text("id,other\n1.5,true\n")
    pair = read_pair(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert (dict(pair.train.dtypes), dict(pair.test.dtypes)) == ({"id": "double", "only a": "int"}, {"id": "double", "other": "boolean"})
    given = read_pair(spark, str(tmp_path / "a.csv"), str(tmp_path / "a.csv"), schema="id string, `only a` string")
    assert dict(given.train.dtypes) == {"id": "string", "only a": "string"}
    inferred = read_pair(spark, str(tmp_path / "a.csv"), str(tmp_path / "a.csv"), inferSchema=True)
    assert dict(inferred.train.dtypes)["id"] == "int"


def test_one_aggregate_reads_both_sides(spark):
    sides = [spark.createDataFrame([("1", None), ("x", None)], "a string, b string"), spark.createDataFrame([("2.5", "true")], "a string, b string")]
    classes = literal_classes(sides)
    assert classes.collect()[0].asDict() == {"a": INTEGER | TEXT | REAL, "b": TRUTH}
    plan = classes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    assert [dict(t.dtypes) for t in as_typed(sides)] == [{"a": "string", "b": "boolean"}] * 2
    assert [dict(t.dtypes) for t in as_typed([t.limit(0) for t in sides])] == [{"a": "string", "b": "string"}] * 2
