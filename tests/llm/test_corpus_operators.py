"""Fixity audit, language-model scores, the pipeline, and the SQL of registered queries."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
import corpus_pipeline
from leakscan.llm import lm_scores, warc_fixity
from leakscan.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_scores_equal_python(spark, monkeypatch):
    monkeypatch.setattr("leakscan.llm.exchange.BATCH_ROWS", 3)
    texts = ["a b c a b c", "a b d", "", None, "new words only", "a b c d e", "b", "A b", "a b c a b c"]
    frame = spark.createDataFrame([(i if i != 6 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, batch int")
    for order in (1, 2, 3):
        total = {n: Counter() for n in range(1, order + 1)}
        grams = lambda w, n: Counter(tuple(w[i - n + 1 : i + 1]) for i in range(n - 1, len(w)))
        split = [(t or "").split() for t in texts]
        for w in split:
            for n in total:
                total[n] += grams(w, n)
        size = sum(map(len, split))
        for r in lm_scores.backoff_scores(frame, order).collect():
            w = split[6 if r.doc_id is None else r.doc_id]
            other = {n: total[n] - grams(w, n) for n in total}
            score = full = unseen = 0
            for i in range(len(w)):
                n = min(order, i + 1)
                factor = 1.0
                while n > 1 and not other[n][tuple(w[i - n + 1 : i + 1])]:
                    n, factor = n - 1, factor * 0.4
                count = other[n][tuple(w[i - n + 1 : i + 1])]
                if n > 1:
                    chance = count / other[n - 1][tuple(w[i - n + 1 : i])]
                else:
                    chance = count / (size - len(w)) if count else 1 / (size - len(w) + 1)
                full += n == order and count > 0
                unseen += n == 1 and not count
                score += math.log(factor * chance)
            assert (r.n_words, r.n_full, r.n_unseen) == (len(w), full, unseen)
            assert math.isclose(r.log_score, score, abs_tol=1e-9)
            assert (r.mean_score is None) == (not w)
    assert lm_scores.backoff_scores(frame.limit(0)).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, archive int")


def test_fixity_finds_each_kind_of_damage(spark):
    rows = [(i, f"http://h/{i}", f"<p>{'x' * (i % 50)}{i}</p>") for i in range(3000)] + [(None, None, None), (None, "u", "h"), *[(5, "http://h/5", "again")] * 3]
    wrong = [(i, u, h + "!" if i == 700 else h) for i, u, h in rows if i not in (40, 1999)] + [(9000, "http://new", "n")]
    wrong.remove((5, "http://h/5", "again"))
    found = warc_fixity.fixity_report(pages(spark, rows), pages(spark, wrong)).collect()
    assert sorted((str(r.page_id), r.kind, r.primary_copies, r.replica_copies) for r in found) == [
        ("1999", "missing", 1, 0), ("40", "missing", 1, 0), ("5", "changed", 3, 2), ("700", "changed", 1, 1), ("9000", "extra", 0, 1)
    ]
    same = pages(spark, rows)
    assert warc_fixity.fixity_report(same, same.repartition(5)).count() == 0
    empty = same.limit(0)
    assert warc_fixity.fixity_report(empty, empty).count() == 0
    assert warc_fixity.fixity_report(empty, same).where("kind = 'extra'").agg(F.sum("replica_copies")).first()[0] == len(rows)


def test_offsets_follow_the_records(spark):
    own = warc_fixity.leaves(pages(spark, [(i, "u", "é" * i) for i in range(20)]), 1).orderBy("place").collect()
    at = 0
    for r in own:
        assert r.offset == at
        at += r.length * r.copies


@pytest.mark.parametrize("name", oracle_sql())
def test_query_equals_sql(spark, name):
    sql = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "labels"):
        sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = queries()[name](spark, SF)
    result = sql.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(frame.columns)
    rows = lambda found: sorted(tuple(None if v is None else round(v, 5) if isinstance(v, float) else v for v in r) for r in found)
    assert rows(frame.select(*names).collect()) == rows(result.fetchall())


def test_pipeline_keeps_columns_and_effects(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(5)).withColumn("row_id", F.lit("mine"))
    columns, counts = docs.columns, [docs.count()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        counts.append(docs.count())
        assert number == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[-1] >= counts[-2] > 0
    ids = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/1").select("doc_id").collect()]
    assert len(set(ids)) == len(ids)
    empty = spark.read.parquet(f"{tmp_path}/3").limit(0)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, empty, SF).write.parquet(f"{tmp_path}/empty{number}")
        empty = spark.read.parquet(f"{tmp_path}/empty{number}")
        assert empty.count() == 0


def test_registry():
    names = [n for n in registry.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert registry.queries()["pipeline"] is corpus_pipeline.run
