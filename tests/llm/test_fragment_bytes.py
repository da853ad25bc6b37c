"""The bytes of fragments are shuffled once, and tables of fragments go as soon as their masks are written."""

import random

import numpy as np
import pyarrow as pa

from leakscan import scratch
from leakscan.llm import repeats


def texts(spark):
    words = [f"word{i}" for i in range(300)]
    base = " ".join(random.Random(1).choices(words, k=200))
    rows = [(i, base[: 400 + 10 * i] + f" other{i} " + base[500:900]) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_bytes_of_fragments_are_shuffled_once(spark, monkeypatch):
    plans = {}

    def recorded(frame, name, *rest):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return scratch.materialize(frame, name, *rest)

    monkeypatch.setattr(repeats, "materialize", recorded)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with scratch.written_meanwhile() as left:
            rows = {r.doc_id: r for r in repeats.repeat_report(texts(spark)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # one exchange for the fragments with their bytes, one for the table that says which are needed
    assert plans["different"].count("Exchange hashpartitioning") == 2
    kept = {table.inputFiles()[0].split("/")[-2] for table in left if table.inputFiles()}
    assert "owned" in kept and not kept & {"shared", "several", "different"}
    assert rows[0].n_removed == 0 and all(rows[i].n_removed > 300 for i in range(1, 6))


def test_lost_windows_become_runs_for_many_documents_at_once():
    rows = [(1, 0, 10, 0b0110), (1, 0, 14, 0b1), (1, 0, 15, 0b11), (1, 2, 0, 0b1), (4, 2, 1, (1 << 31) - 1), (4, 3, 5, 0)]
    batch = pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("batch", "place", "first", "lost"), zip(*rows, strict=True), strict=True)})
    (found,) = repeats._runs(iter([batch]))
    runs = [np.frombuffer(x, np.int64).reshape(-1, 2).tolist() for x in found.column("answers").to_pylist()]
    assert list(zip(found.column("batch").to_pylist(), found.column("range").to_pylist(), runs, strict=True)) == [
        (1, 0, [[11, 2], [14, 3]]), (1, 2, [[0, 1]]), (4, 2, [[1, 31]]), (4, 3, [])]
