"""Models are scored in a session in which a job was observed, as write_findings does."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Observation, functions as F

from leakscan import PROTOCOLS, ModelSettings, scratch
from leakscan.plans.impact import score_model


@pytest.mark.parametrize("key", ["clean", "forest_group"])
def test_scores_after_an_observation(spark, key):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 3
    rows = spark.range(200).selectExpr("id", "CAST(id % 2 AS double) AS y", "if(id % 5 = 0, 'test', 'train') AS split", "id % 2 + 0.01 * (id % 7) AS x")
    prepared = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    protocol = next(p for p in PROTOCOLS if p.key == key)
    before = len(scratch._written)
    row = score_model(prepared, protocol, ModelSettings(trees=5)).first()
    assert (row.n_train, row.n_test, row.roc_auc) == (160, 40, 1.0)
    assert len(scratch._written) == before + 1  # the ranges of scores; the model's folder is gone
