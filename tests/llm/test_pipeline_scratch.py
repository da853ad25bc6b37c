"""Stages of the pipeline delete what the stage before them wrote, and no more."""

import corpus_pipeline
from leakscan import scratch
from leakscan.llm import pseudonyms

SF = "/root/testdata/sf0.001"


def test_each_stage_deletes_what_the_one_before_left(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    own = scratch.materialize(docs, "own")
    before = len(scratch._written)
    sizes = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        sizes.append(len(scratch._written) - before)
        assert len(corpus_pipeline._left) == sizes[-1]
    assert sizes[1] > 0
    assert own.count() == 60 and docs.count() > 0


def test_long_addresses_survive(spark):
    text = "write to x@b" + ".c" * 20_000 + " or to joe@example.com"
    found = spark.createDataFrame([(1, text)], "doc_id long, text string")
    new = pseudonyms.pseudonymize(found, "key").first().text
    assert new.endswith("@example.com") and new != text and len(new) == len(text)
