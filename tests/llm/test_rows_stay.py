"""Dropping near duplicates shuffles no whole rows and writes each text once, however many documents there are."""

import random

import pytest

from leakscan.llm import common, near_dedup


def documents(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(random.Random(i).choices(words, k=60)) for i in range(30)]
    rows = [(7 * i, text, "en") for i, text in enumerate(texts)]
    rows += [(500 + i, text + " end", "de") for i, text in enumerate(texts[:9])] + [(900, None, "en"), (901, " ", None), (None, texts[12], "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_whole_rows_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)  # fewer than the distinct texts
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # small tables are not broadcast unasked
    try:
        kept = near_dedup.drop_near_duplicates(documents(spark))
        plan = plan_of(kept)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in plan
    assert kept.columns == ["doc_id", "text", "lang"]
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == {7 * i for i in range(30)} | {900, 901}
    assert rows[900].text is None and rows[0].lang == "en" and len(rows[0].text.split()) == 60


def test_a_text_is_written_once(spark):
    features = near_dedup._with_features(documents(spark), keep_row=True)
    assert "text" in features.columns and features.schema["row"].dataType.names == ["doc_id", "lang"]
    whole = near_dedup.near_duplicates(documents(spark), keep_row=True).select("row.*")
    assert whole.columns == ["doc_id", "text", "lang"] and whole.where("text is not null").count() == 41


@pytest.mark.parametrize("bound", [0, 100])
def test_rows_among_numbers(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    numbers = [0, 1, 62, 63, 64, 127, 4095, 4096, 5000, (1 << 33) + 63, (3 << 33) + 4159]
    rows = spark.createDataFrame([(n, str(n)) for n in numbers], "id long, name string")
    wanted = {0, 63, 64, 4095, (1 << 33) + 63}
    ids = spark.createDataFrame([(n,) for n in [*wanted, 63, 2, 9_999]], "i long")
    assert {r.id for r in common.among(rows, "id", ids).collect()} == wanted
    rest = common.among(rows, "id", ids, wanted=False)
    assert rest.columns == ["id", "name"] and {r.id for r in rest.collect()} == set(numbers) - wanted
