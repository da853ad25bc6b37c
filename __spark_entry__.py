"""

Every split covers its whole table: each row is on the train side or on the test side.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import leakscan as ls
from leakscan.scratch import claim, materialize

CUT = "2000-01-01"
SMOKE_DIR = "/root/testdata/sf0.001"
LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_FLAGS = ["l_returnflag", "l_linestatus"]


# --- inputs ---------------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_date(table: DataFrame, column: str) -> DataFrame:
    before = F.col(column) < F.lit(CUT).cast("timestamp_ntz")
    return table.withColumn("split", F.when(before, "train").otherwise("test"))


def _orders_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_date(_read(spark, sf_dir, "orders"), "o_orderdate")


def _lines_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_date(_read(spark, sf_dir, "lineitem"), "l_shipdate")


def _conversations_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").withColumn("turn_id", F.concat_ws("-", "conv_id", "turn"))
    return ls.stratified_row_split(turns, "turn_id", "role")


def _orders_with_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))


def _labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents"), "doc_id")


def _document_study(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ls.ImpactInput]:
    table = _labelled_documents(spark, sf_dir).select(
        "doc_id",
        "source",
        "quality",
        "lang",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", r"\s+")).cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        F.octet_length("text").cast("double").alias("n_bytes"),
    )
    roles = ls.ImpactInput("doc_id", "source", "quality", "source", ("n_chars", "n_words"), ("n_lines", "n_bytes"))
    return table, roles


# --- queries --------------------------------------------------------------------------------


def group_overlap_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = ls.split_pair(_orders_by_date(spark, sf_dir))
    return ls.ordered_groups(ls.group_overlap(pair, "o_custkey"))


def group_overlap_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ls.stratified_row_split(_read(spark, sf_dir, "events"), "event_id", "event_type")
    return ls.group_overlap(ls.split_pair(events), "user_id")


def group_overlap_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = ls.stratified_row_split(_read(spark, sf_dir, "documents"), "doc_id", "lang")
    return ls.group_overlap(ls.split_pair(documents), "source")


def shared_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.group_overlap(ls.split_pair(_conversations_by_row(spark, sf_dir)), "conv_id")


def typed_group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view"), "str").otherwise("int")
    events = _by_mid_month(_read(spark, sf_dir, "events")).withColumn(
        "mixed_id", F.struct(kind.alias("type"), F.col("user_id").cast("string").alias("value"))
    )
    return ls.group_overlap(ls.split_pair(events), "mixed_id")


def _by_mid_month(events: DataFrame) -> DataFrame:
    before = F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz")
    return events.withColumn("split", F.when(before, "train").otherwise("test"))


def group_preview_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.group_preview(ls.group_overlap(ls.split_pair(_orders_by_date(spark, sf_dir)), "o_custkey"))


def rows_of_shared_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = ls.split_pair(_orders_by_date(spark, sf_dir).select("o_orderkey", "o_custkey", "split"))
    return ls.rows_in_overlap(pair, "o_custkey", "test")


def input_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = ls.split_pair(_lines_by_date(spark, sf_dir))
    return ls.input_profile(pair, [*LINE_NUMERIC, *LINE_FLAGS]).withColumnsRenamed(
        {f"max_abs_{i}": f"max_{name}" for i, name in enumerate(LINE_NUMERIC)}
    )


def _line_matches(spark: SparkSession, sf_dir: str, numeric: list[str], near_atol: float, **options) -> DataFrame:
    pair = ls.split_pair(_lines_by_date(spark, sf_dir))
    found = ls.audit_split(pair, [*numeric, *LINE_FLAGS], near_atol=near_atol, **options).matches.vectors
    return found.select(
        *[F.col(f"_n{i}").alias(name) for i, name in enumerate(numeric)],
        *[F.col(f"_c{i}").alias(name) for i, name in enumerate(LINE_FLAGS)],
        F.col("n_test").alias("n_test_rows"),
        F.round("distance", 6).alias("distance"),
        "kind",
    )


def exact_match_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_matches(spark, sf_dir, ["l_quantity", "l_discount", "l_tax"], 1e-3)


def near_match_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_matches(spark, sf_dir, LINE_NUMERIC, 2.0)


def near_match_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ids that repeat, and a search that goes through several radii."""
    limits = ls.SearchLimits(pairs_per_vector=1, min_pair_budget=1)
    return _line_matches(spark, sf_dir, LINE_NUMERIC, 2.0, id_columns=["l_orderkey"], limits=limits)


def _rounded(matches: DataFrame) -> DataFrame:
    return matches.withColumn("distance", F.round("distance", 6))


def near_match_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = ls.audit_split(
        ls.split_pair(_orders_by_date(spark, sf_dir)), ["o_totalprice", "o_orderstatus"],
        near_atol=5.0, id_columns=["o_orderkey"],
    )
    return _rounded(audit.row_matches)


def copied_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = ls.stratified_row_split(_read(spark, sf_dir, "documents"), "doc_id", "lang")
    audit = ls.audit_split(ls.split_pair(documents), ["text", "lang"], id_columns=["doc_id"])
    return audit.row_matches.select("test_id", "train_id", "kind")


def near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ls.stratified_row_split(_read(spark, sf_dir, "embeddings"), "vec_id", "label")
    wide = ls.expand_vectors(vectors, "embedding", 64, "e")
    audit = ls.audit_split(
        ls.split_pair(wide), [f"e_{i}" for i in range(64)], near_atol=0.3, id_columns=["vec_id"]
    )
    return _rounded(audit.row_matches)


def _flat(summary: DataFrame) -> DataFrame:
    return summary.withColumn("feature_columns", F.array_join("feature_columns", ","))


def audit_summary_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = ls.audit_split(
        ls.split_pair(_orders_by_date(spark, sf_dir)), ["o_totalprice", "o_orderstatus"], "o_custkey",
        near_atol=5.0, id_columns=["o_orderkey"],
    )
    return _flat(audit.summary)


def default_features_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features are all columns but group and target."""
    parts = _read(spark, sf_dir, "part")
    split = ls.stratified_row_split(parts, "p_partkey", "p_type").drop("p_partkey", "p_name")
    pair = ls.split_pair(split)
    features = ls.resolve_features(pair, group="p_brand", target="p_type")
    summary = ls.audit_split(pair, features, "p_brand", near_atol=0.25).summary
    return _flat(summary).select(
        "n_train", "n_test", "feature_columns", "exact_duplicate_rows", "near_duplicate_rows", "n_overlapping_groups"
    )


def audit_both_splits_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = ls.stratified_row_split(_read(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", into="by_row")
    orders = ls.group_split(orders, "o_custkey", into="by_group")
    return _flat(
        ls.audit_both_splits(
            materialize(orders, "orders"), ["o_totalprice", "o_orderstatus"], "o_custkey",
            {"random": "by_row", "group": "by_group"}, near_atol=1.0, id_columns=["o_orderkey"],
        )
    )


def csv_audit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = claim(spark, "csv-audit")
    pair = ls.split_pair(_orders_by_date(spark, sf_dir))
    for side in ("train", "test"):
        getattr(pair, side).write.mode("overwrite").csv(f"{folder}/{side}", header=True)
    ls.audit_job(
        spark, f"{folder}/train", f"{folder}/test", "o_totalprice, o_orderstatus", "o_custkey",
        near_atol=5.0, id_columns=["o_orderkey"], output=f"{folder}/findings", mode="overwrite",
    )
    return _flat(spark.read.parquet(f"{folder}/findings/summary"))


def csv_text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies in CSV files whose columns look like truth values, numbers or dates on one side, or in part, only."""
    orders = ls.stratified_row_split(_read(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus")
    month = F.trunc("o_orderdate", "MM")
    rows = orders.select(
        "o_orderkey",
        "split",
        F.expr("CASE o_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE if(split = 'test', 'maybe', 'no') END").alias("answer"),
        F.expr("concat(o_custkey % 4, if(o_orderkey % 2 = 0, 'D', 'F'))").alias("code"),
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(month, "yyyy-M-d")).otherwise(F.date_format(month, "yyyy-MM-dd")).alias("month"),
        F.expr("concat(o_custkey % 6, if(split = 'test', '.0', ''))").alias("size"),
    )
    folder = claim(spark, "csv-text")
    pair = ls.split_pair(rows)
    for side in ("train", "test"):
        getattr(pair, side).write.csv(f"{folder}/{side}", header=True)
    found = ls.audit_job(spark, f"{folder}/train", f"{folder}/test", ["answer", "code", "month", "size"], id_columns=["o_orderkey"])
    return _rounded(found.row_matches).withColumns({name: F.col(name).cast("long") for name in ("test_id", "train_id")})


def json_mixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared ids of JSON files in which one field holds whole numbers, numbers with a fraction and texts."""
    pair = ls.split_pair(_orders_by_date(spark, sf_dir))
    line = """concat('{"order":', o_orderkey, ',"ref":', CASE o_orderkey % 4
        WHEN 0 THEN concat('"', o_custkey, '"') WHEN 1 THEN concat(o_custkey % 900, '.50') WHEN 2 THEN 'null' ELSE string(o_custkey) END, '}')"""
    folder = claim(spark, "json-mixed")
    for side in ("train", "test"):
        getattr(pair, side).selectExpr(line).write.text(f"{folder}/{side}")
    mixed = ls.read_pair(spark, f"{folder}/train", f"{folder}/test", "json", "`order` bigint, ref variant")
    return ls.group_overlap(mixed, "ref")


def placed_matches_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of Parquet files without id columns, named by file and row, and whether each names two rows that match."""
    sides = ls.split_pair(_orders_by_date(spark, sf_dir))
    folder = claim(spark, "placed")
    for side in ("train", "test"):
        getattr(sides, side).write.parquet(f"{folder}/{side}")
    paths = f"{folder}/train", f"{folder}/test"
    found = ls.audit_job(spark, *paths, "o_totalprice, o_orderstatus", near_atol=5.0, fmt="parquet", row_ids="place").row_matches
    pair = ls.read_pair(spark, *paths, "parquet", row_ids="place")
    train, test = (
        rows.select(F.col("place").alias(f"{side}_id"), F.struct("o_orderkey", "o_totalprice", "o_orderstatus").alias(side))
        for side, rows in (("train", pair.train), ("test", pair.test))
    )
    agrees = (F.col("train.o_orderstatus") == F.col("test.o_orderstatus")) & (
        F.abs(F.col("train.o_totalprice") - F.col("test.o_totalprice")) == F.col("distance")
    )
    return found.join(test, "test_id", "left").join(train, "train_id", "left").select(
        "test.o_orderkey", F.round("distance", 6).alias("distance"), "kind", F.coalesce(agrees, F.lit(False)).alias("names_match")
    )


def _committed(spark: SparkSession, sf_dir: str) -> tuple[str, ls.WrittenFindings]:
    audit = ls.audit_split(
        ls.split_pair(_orders_by_date(spark, sf_dir)), ["o_totalprice", "o_orderstatus"], "o_custkey", near_atol=5.0, id_columns=["o_orderkey"]
    )
    path = claim(spark, "findings")
    return path, ls.write_findings(audit, path)


def committed_findings_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and a total of each part of committed findings, read back and held against their manifest."""
    found = ls.read_findings(spark, _committed(spark, sf_dir)[0])
    totals = {
        "summary": F.sum(F.expr("exact_duplicate_rows + near_duplicate_rows")),
        "row_matches": F.count_if(F.col("kind") == "exact"),
        "group_overlap": F.sum("n_train"),
    }
    result = None
    for part, total in totals.items():
        row = getattr(found, part).agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(total, F.lit(0)).cast("long").alias("total"))
        result = row if result is None else result.unionByName(row)
    return result


def gate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict, as the job that wrote the findings observed it."""
    seen = _committed(spark, sf_dir)[1].summary
    wanted = ("exact_duplicate_rows", "near_duplicate_rows", "n_overlapping_groups")
    return spark.createDataFrame(
        [(*[seen[name] for name in wanted], seen["has_leakage"])], ", ".join([*[f"{name} bigint" for name in wanted], "has_leakage boolean"])
    )


def ordered_matches_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near matches with their place in the order of test id and train id."""
    audit = ls.audit_split(
        ls.split_pair(_orders_by_date(spark, sf_dir)), ["o_totalprice", "o_orderstatus"], near_atol=5.0, id_columns=["o_orderkey"]
    )
    return _rounded(audit.positioned_matches("near"))


BROKEN_FEATURES = ["l_quantity", "l_extendedprice", "l_tax", "l_returnflag"]


def _broken_lines(spark: SparkSession, sf_dir: str) -> ls.SplitPair:
    """Line items of which some lack a quantity, a flag or a tax, and some have an infinite price."""
    lines = _lines_by_date(spark, sf_dir).withColumns({
        "l_quantity": F.expr("if(l_orderkey % 7 = 0, NULL, l_quantity)"),
        "l_extendedprice": F.expr("CASE l_partkey % 11 WHEN 0 THEN double('Infinity') WHEN 1 THEN double('-Infinity') ELSE l_extendedprice END"),
        "l_tax": F.expr("if(l_suppkey % 5 = 0, double('NaN'), l_tax)"),
        "l_returnflag": F.expr("nullif(l_returnflag, 'R')"),
    })
    return ls.split_pair(lines)


def rule_violations_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every missing or infinite feature of every line item."""
    return ls.rule_violations(_broken_lines(spark, sf_dir), BROKEN_FEATURES, ["l_orderkey", "l_linenumber"])


def violation_samples_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each feature breaks each rule, with the ten line items of the smallest hashes."""
    ids = ["l_orderkey", "l_linenumber"]
    found = ls.violation_samples(ls.rule_violations(_broken_lines(spark, sf_dir), BROKEN_FEATURES, ids), ids)
    return found.withColumn("sample", F.array_join("sample", " "))


def input_profile_broken_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that stop an audit, on rows that do break the rules."""
    return ls.input_profile(_broken_lines(spark, sf_dir), BROKEN_FEATURES).select("side", "n_rows", "rows_with_missing", "rows_with_nonfinite")


def stratified_split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    return ls.stratified_row_split(orders, "o_orderkey", "o_orderstatus").select("o_orderkey", "split")


def stratified_split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.stratified_row_split(_read(spark, sf_dir, "labels"), "doc_id", "toxic").select("doc_id", "split")


def group_split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.group_split(_read(spark, sf_dir, "orders"), "o_custkey").select("o_orderkey", "split")


def encoding_map_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoding, mean = ls.fit_target_encoding(_labelled_documents(spark, sf_dir), "source", "quality")
    return encoding.select(
        "code", F.round("encoded", 6).alias("encoded"), "n", F.round(F.lit(mean), 6).alias("overall_mean")
    )


def _encoded_orders(spark: SparkSession, sf_dir: str, population: str) -> DataFrame:
    orders = ls.stratified_row_split(_orders_with_label(spark, sf_dir), "o_orderkey", "o_orderstatus")
    encoding, mean = ls.fit_target_encoding(ls.fit_rows(orders, population), "o_custkey", "y")
    encoded = ls.apply_target_encoding(orders, encoding, mean, "o_custkey")
    return encoded.select("o_orderkey", "split", F.round("encoded", 6).alias("encoded"))


def target_encoding_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded_orders(spark, sf_dir, "all")


def target_encoding_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded_orders(spark, sf_dir, "train")


def scaler_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.fit_scaler(_read(spark, sf_dir, "lineitem"), LINE_NUMERIC).select(
        "column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")
    )


def scaled_features_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ls.group_split(_read(spark, sf_dir, "part"), "p_brand")
    scaler = ls.fit_scaler(ls.fit_rows(parts, "train"), ["p_size", "p_retailprice"])
    return ls.apply_scaler(parts, scaler).select(
        "p_partkey",
        "split",
        F.round("p_size_scaled", 6).alias("p_size_scaled"),
        F.round("p_retailprice_scaled", 6).alias("p_retailprice_scaled"),
    )


def design_matrix_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance scaled and segment encoded on all rows, assembled into one vector and read back."""
    from pyspark.ml.functions import vector_to_array

    customers = _read(spark, sf_dir, "customer").withColumn("y", (F.col("c_nationkey") < 12).cast("int"))
    encoding, mean = ls.fit_target_encoding(customers, "c_mktsegment", "y")
    encoded = ls.apply_target_encoding(customers, encoding, mean, "c_mktsegment")
    columns = ["c_acctbal", "encoded"]
    scaled = ls.apply_scaler(encoded, ls.fit_scaler(encoded, columns))
    matrix = ls.design_matrix(scaled, [f"{name}_scaled" for name in columns])
    values = vector_to_array("features")
    return matrix.select("c_custkey", F.round(values[0], 6).alias("f0"), F.round(values[1], 6).alias("f1"))


def _line_scores(spark: SparkSession, sf_dir: str, score) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem")
    scored = lines.select(score.alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return ls.binary_metrics(scored)


def _round_metrics(frame: DataFrame, names: list[str]) -> DataFrame:
    return frame.withColumns({name: F.round(name, 6) for name in names})


METRIC_NAMES = ["accuracy", "f1", "roc_auc", "average_precision"]


def binary_metrics_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score with few ties."""
    return _round_metrics(_line_scores(spark, sf_dir, F.col("l_extendedprice") / 200000), METRIC_NAMES)


def binary_metrics_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score with fifty distinct values."""
    return _round_metrics(_line_scores(spark, sf_dir, F.col("l_quantity") / 64), METRIC_NAMES)


def binary_metrics_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _labelled_documents(spark, sf_dir).select(
        (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("score"), F.col("toxic").alias("y")
    )
    return _round_metrics(ls.binary_metrics(scored), METRIC_NAMES)


def metric_gap_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = None
    for key, score in (("leaky", F.col("l_extendedprice") / 200000), ("clean", F.col("l_quantity") / 64)):
        row = _line_scores(spark, sf_dir, score).withColumn("key", F.lit(key))
        scores = row if scores is None else scores.unionByName(row)
    return _round_metrics(ls.metric_gap(scores), [f"{name}_gap" for name in METRIC_NAMES])


def threshold_predict_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem")
    return (
        lines.select(
            ls.threshold_predict(F.col("l_quantity") / 50).alias("predicted"),
            (F.col("l_returnflag") == "R").cast("int").alias("y"),
        )
        .groupBy("predicted", "y")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def dataset_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = ls.dataset_profile(_orders_with_label(spark, sf_dir), "o_custkey", "y")
    return profile.withColumn("positive_rate", F.round("positive_rate", 6))


def table_fingerprint_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.table_fingerprint(_read(spark, sf_dir, "lineitem"))


def table_fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.table_fingerprint(_read(spark, sf_dir, "documents"))


PLANTED = {"n_exact": 50, "n_near": 40, "n_groups": 5}


def _planted_orders(spark: SparkSession, sf_dir: str):
    orders = ls.group_split(_read(spark, sf_dir, "orders"), "o_custkey")
    features = ["o_totalprice", "o_orderstatus"]
    planted = ls.plant_leaks(ls.split_pair(orders), "o_orderkey", features, "o_custkey", **PLANTED)
    return planted, ls.audit_split(planted.pair, features, "o_custkey", id_columns=["o_orderkey"])


def plant_leaks_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted, audit = _planted_orders(spark, sf_dir)
    return ls.recall(planted.truth, audit.row_matches)


def check_expectations_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts found in a split with planted leaks against the planted counts."""
    planted, audit = _planted_orders(spark, sf_dir)
    kinds = {"exact": "expect_exact", "near": "expect_near", "group": "expect_groups"}
    expected = planted.truth.agg(
        *[F.count_if(F.col("kind") == kind).alias(name) for kind, name in kinds.items()]
    ).withColumn("name", F.lit("orders"))
    return ls.check_expectations(audit.summary.withColumn("name", F.lit("orders")), expected)


def _study_scores(spark: SparkSession, sf_dir: str, keys: tuple[str, ...]) -> DataFrame:
    from leakscan.plans.impact import split_both_ways

    table, roles = _document_study(spark, sf_dir)
    chosen = [protocol for protocol in ls.PROTOCOLS if protocol.key in keys]
    return ls.score_protocols(split_both_ways(table, roles), roles, chosen)


def protocol_scores_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study_scores(spark, sf_dir, ("leaky", "group_leak", "preprocess_leak", "clean", "clinical_only"))


def protocol_scores_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _study_scores(spark, sf_dir, ("forest_random", "forest_group"))


def scaler_only_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leakscan.plans.impact import split_both_ways

    table, roles = _document_study(spark, sf_dir)
    return ls.scaler_only_delta(split_both_ways(table, roles), roles)


def leakage_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap between the leaky and the clean protocol, with both audits made on the way."""
    table, roles = _document_study(spark, sf_dir)
    chosen = [protocol for protocol in ls.PROTOCOLS if protocol.key in ("leaky", "clean")]
    impact = ls.leakage_impact(table, roles, protocols=chosen)
    audits = impact.audits.select(
        F.lit(None).cast("double").alias("roc_auc_gap"),
        F.col("split_kind").alias("item"),
        F.col("n_overlapping_groups").alias("n"),
    )
    gap = impact.gap.select("roc_auc_gap", F.lit("gap").alias("item"), F.lit(0).cast("bigint").alias("n"))
    return gap.unionByName(audits)


_QUERIES = (
    group_overlap_customers,
    group_overlap_users,
    group_overlap_sources,
    shared_conversations,
    typed_group_ids,
    group_preview_customers,
    rows_of_shared_customers,
    input_profile_lineitem,
    exact_match_lineitem,
    near_match_lineitem,
    near_match_repeated_ids,
    near_match_orders,
    copied_documents,
    near_embeddings,
    audit_summary_orders,
    default_features_part,
    audit_both_splits_orders,
    csv_audit_orders,
    csv_text_columns,
    json_mixed_ids,
    placed_matches_orders,
    committed_findings_orders,
    gate_orders,
    ordered_matches_orders,
    rule_violations_lineitem,
    violation_samples_lineitem,
    input_profile_broken_lineitem,
    stratified_split_orders,
    stratified_split_labels,
    group_split_orders,
    encoding_map_sources,
    target_encoding_all,
    target_encoding_train,
    scaler_lineitem,
    scaled_features_part,
    design_matrix_customer,
    binary_metrics_lineitem,
    binary_metrics_ties,
    binary_metrics_labels,
    metric_gap_lineitem,
    threshold_predict_lineitem,
    dataset_profile_orders,
    table_fingerprint_lineitem,
    table_fingerprint_documents,
    plant_leaks_recall,
    check_expectations_orders,
    protocol_scores_logistic,
    protocol_scores_forest,
    scaler_only_delta,
    leakage_impact,
)


# --- SQL counterparts -----------------------------------------------------------------------


def _stratified(table: str, ident: str, label: str, into: str = "split") -> str:
    """Rows of ``table`` with the split column, as a chain of subqueries."""
    return f"""
    (SELECT t.*, CASE WHEN row_number() OVER (
                PARTITION BY t.{label} ORDER BY md5('42|' || CAST(t.{ident} AS VARCHAR)), t.{ident}) <= q.take
            THEN 'test' ELSE 'train' END AS {into}
     FROM {table} t JOIN (
        SELECT cls, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, CAST(cls AS VARCHAR)) <= spare
                           THEN 1 ELSE 0 END AS take
        FROM (SELECT cls, (n * n_test) // total AS base, (n * n_test) % total AS rem,
                     n_test - sum((n * n_test) // total) OVER () AS spare
              FROM (SELECT {label} AS cls, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
                           CAST(ceil(sum(count(*)) OVER () * 0.25) AS BIGINT) AS n_test
                    FROM {table} GROUP BY {label}))
     ) q ON t.{label} = q.cls)"""


def _grouped(table: str, group: str, into: str = "split") -> str:
    return f"""
    (SELECT t.*, CASE WHEN g.place <= ceil(g.total * 0.25) THEN 'test' ELSE 'train' END AS {into}
     FROM {table} t JOIN (
        SELECT grp, row_number() OVER (ORDER BY md5('42|' || CAST(grp AS VARCHAR)), grp) AS place,
               count(*) OVER () AS total
        FROM (SELECT DISTINCT {group} AS grp FROM {table})
     ) g ON t.{group} = g.grp)"""


def _dated(table: str, column: str, cut: str = CUT) -> str:
    return f"(SELECT *, CASE WHEN {column} < TIMESTAMP '{cut}' THEN 'train' ELSE 'test' END AS split FROM {table})"


def _overlap(rows: str, group: str, label: str) -> str:
    return f"""
    SELECT {label} AS label, n_train, n_test
    FROM (SELECT {group} AS id, count(*) FILTER (split = 'train') AS n_train,
                 count(*) FILTER (split = 'test') AS n_test
          FROM {rows} WHERE {group} IS NOT NULL GROUP BY ALL)
    WHERE n_train > 0 AND n_test > 0"""


def _line_match_sql(numeric: list[str], atol: float) -> str:
    features = ", ".join([*numeric, *LINE_FLAGS])
    gaps = [f"abs(q.{name} - t.{name})" for name in numeric]
    band = " AND ".join(f"{gap} <= {atol}" for gap in gaps)
    return f"""
    WITH rows AS (SELECT * FROM {_dated("lineitem", "l_shipdate")}),
    t AS (SELECT DISTINCT {features} FROM rows WHERE split = 'train'),
    q AS (SELECT {features}, count(*) AS n_test_rows FROM rows WHERE split = 'test' GROUP BY ALL),
    best AS (
        SELECT {", ".join(f"q.{name}" for name in [*numeric, *LINE_FLAGS])}, q.n_test_rows,
               min(greatest({", ".join(gaps)})) AS d
        FROM q JOIN t ON q.l_returnflag = t.l_returnflag AND q.l_linestatus = t.l_linestatus AND {band}
        GROUP BY ALL)
    SELECT {features}, n_test_rows, round(d, 6) AS distance,
           CASE WHEN d <= 1e-8 THEN 'exact' ELSE 'near' END AS kind
    FROM best"""


def _order_best(rows: str, atol: float) -> str:
    """Nearest train order of the same status for every test order, as (test_id, train_id, d)."""
    return f"""
        SELECT q.o_orderkey AS test_id, arg_min(t.o_orderkey, (abs(q.o_totalprice - t.o_totalprice), t.o_orderkey)) AS train_id,
               min(abs(q.o_totalprice - t.o_totalprice)) AS d
        FROM {rows} q JOIN {rows} t
          ON q.split = 'test' AND t.split = 'train' AND q.o_orderstatus = t.o_orderstatus
         AND abs(q.o_totalprice - t.o_totalprice) <= {atol}
        GROUP BY q.o_orderkey"""


def _order_summary(rows: str, atol: float, prefix: str = "") -> str:
    return f"""
    SELECT {prefix}
        (SELECT count(*) FROM {rows} WHERE split = 'train') AS n_train,
        (SELECT count(*) FROM {rows} WHERE split = 'test') AS n_test,
        'o_totalprice,o_orderstatus' AS feature_columns, 'o_custkey' AS group_column,
        CAST(1e-8 AS DOUBLE) AS exact_atol, CAST({atol} AS DOUBLE) AS near_atol,
        exact_duplicate_rows, near_duplicate_rows, n_overlapping_groups,
        'typed; missing values never overlap' AS group_equality_rule,
        train_rows_with_overlapping_group, test_rows_with_overlapping_group,
        exact_duplicate_rows + near_duplicate_rows + n_overlapping_groups > 0 AS has_leakage
    FROM (SELECT count(*) FILTER (d <= 1e-8) AS exact_duplicate_rows, count(*) FILTER (d > 1e-8) AS near_duplicate_rows
          FROM ({_order_best(rows, atol)})),
         (SELECT count(*) AS n_overlapping_groups, CAST(coalesce(sum(n_train), 0) AS BIGINT) AS train_rows_with_overlapping_group,
                 CAST(coalesce(sum(n_test), 0) AS BIGINT) AS test_rows_with_overlapping_group
          FROM ({_overlap(rows, "o_custkey", "'int:' || CAST(id AS VARCHAR)")}))"""


def _violations_sql() -> str:
    rules = (
        ("l_quantity", "missing", "l_orderkey % 7 = 0"), ("l_extendedprice", "nonfinite", "l_partkey % 11 IN (0, 1)"),
        ("l_tax", "missing", "l_suppkey % 5 = 0"), ("l_returnflag", "missing", "l_returnflag = 'R'"),
    )
    return " UNION ALL ".join(
        f"""SELECT split AS side, l_orderkey, l_linenumber, '{name}' AS "column", '{rule}' AS rule
            FROM {_dated("lineitem", "l_shipdate")} WHERE {test}"""
        for name, rule, test in rules
    )


def _encoding_sql(population: str) -> str:
    seen = "" if population == "all" else "WHERE split = 'train'"
    return f"""
    WITH rows AS (SELECT *, CAST(o_orderstatus = 'F' AS INTEGER) AS y
                  FROM {_stratified("orders", "o_orderkey", "o_orderstatus")}),
    fitted AS (SELECT * FROM rows {seen}),
    m AS (SELECT avg(y) AS mean FROM fitted),
    codes AS (SELECT o_custkey, (sum(y) + any_value(mean)) / (count(*) + 1) AS encoded FROM fitted, m GROUP BY o_custkey)
    SELECT o_orderkey, split, round(CAST(coalesce(encoded, mean) AS DOUBLE), 6) AS encoded
    FROM rows LEFT JOIN codes USING (o_custkey), m"""


def _metrics_sql(source: str) -> str:
    return f"""
    SELECT round((hit + neg - alarm) / (pos + neg), 6) AS accuracy,
           round(coalesce(2 * hit / nullif(hit + pos + alarm, 0), 0.0), 6) AS f1,
           round(below / (pos * neg), 6) AS roc_auc,
           round(mass / pos, 6) AS average_precision,
           CAST(pos + neg AS BIGINT) AS n_rows
    FROM (SELECT CAST(sum(p) AS DOUBLE) AS pos, CAST(sum(q) AS DOUBLE) AS neg,
                 CAST(coalesce(sum(p) FILTER (score >= 0.5), 0) AS DOUBLE) AS hit,
                 CAST(coalesce(sum(q) FILTER (score >= 0.5), 0) AS DOUBLE) AS alarm,
                 sum(CAST(q AS DOUBLE) * (CAST(tp AS DOUBLE) - p / 2.0)) AS below,
                 sum(CAST(p AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) AS mass
          FROM (SELECT score, p, q, sum(p) OVER (ORDER BY score DESC) AS tp, sum(q) OVER (ORDER BY score DESC) AS fp
                FROM (SELECT score, CAST(sum(y) AS BIGINT) AS p, CAST(sum(1 - y) AS BIGINT) AS q
                      FROM ({source}) GROUP BY score)))"""


def _line_score_sql(score: str) -> str:
    return f"SELECT {score} AS score, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem"


def _fingerprint_sql(table: str, columns: dict[str, str]) -> str:
    header = ",".join(f"{name}:{kind}" for name, kind in columns.items())
    texts = {
        name: f"strlen({name}) || ':' || {name}" if kind == "string" else f"CAST({name} AS VARCHAR)"
        for name, kind in columns.items()
    }
    parts = " || ';' || ".join(f"coalesce({text}, 'N')" for text in texts.values())
    lanes = ", ".join(
        f"coalesce(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS HUGEINT)), 0) AS l{i}" for i in range(2)
    )
    return f"""
    SELECT substr(sha256('{header}' || '|' || n || '|' || l0 || '|' || l1), 1, 16) AS fingerprint
    FROM (SELECT count(*) AS n, {lanes} FROM (SELECT sha256({parts}) AS h FROM {table}))"""


def _planted_ctes() -> str:
    """Train, test with the planted rows, and the planted rows themselves."""
    n_exact, n_near, n_groups = PLANTED["n_exact"], PLANTED["n_near"], PLANTED["n_groups"]
    return f"""
    base AS (SELECT * FROM {_grouped("orders", "o_custkey")}),
    tops AS (SELECT max(o_orderkey) AS i, max(o_custkey) AS g FROM base),
    picked AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS turn
               FROM base WHERE split = 'train'),
    copies AS (SELECT i + turn AS o_orderkey, g + turn AS o_custkey, o_orderstatus,
                      o_totalprice + CASE WHEN turn > {n_exact} THEN 5e-4 ELSE 0.0 END AS o_totalprice,
                      CASE WHEN turn > {n_exact} THEN 'near' ELSE 'exact' END AS kind
               FROM picked, tops WHERE turn <= {n_exact + n_near}),
    hosts AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS turn
              FROM base WHERE split = 'test'),
    shared AS (SELECT i + turn + {n_exact + n_near} AS o_orderkey, p.o_custkey, h.o_orderstatus, h.o_totalprice, 'group' AS kind
               FROM hosts h JOIN picked p USING (turn), tops WHERE turn <= {n_groups}),
    planted AS (SELECT * FROM copies UNION ALL SELECT * FROM shared),
    rows AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, split FROM base
             UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'test' FROM planted),
    best AS ({_order_best("rows", 1e-3)})"""


def core_oracle_sql() -> dict[str, str]:
    """SQL for every query but the model fits, which are iterative."""
    orders = _dated("orders", "o_orderdate")
    int_label = "'int:' || CAST(id AS VARCHAR)"
    turns = "(SELECT *, conv_id || '-' || turn AS turn_id FROM conversations)"
    mixed = (
        "(SELECT *, struct_pack(kind := CASE WHEN event_type IN ('click', 'view') THEN 'str' ELSE 'int' END, "
        f"v := CAST(user_id AS VARCHAR)) AS mixed_id FROM {_dated('events', 'ts', '2024-01-22')})"
    )
    labelled = "(SELECT * FROM labels JOIN documents USING (doc_id))"
    maxima = ", ".join(f"max(abs({name})) AS max_{name}" for name in LINE_NUMERIC)
    lost = " OR ".join(f"{name} IS NULL" for name in [*LINE_NUMERIC, *LINE_FLAGS])
    wild = " OR ".join(f"isinf({name})" for name in LINE_NUMERIC)
    order_rows = f"(SELECT * FROM {orders})"
    leaky, clean = _line_score_sql("l_extendedprice / 200000"), _line_score_sql("l_quantity / 64")
    by_row = _stratified("orders", "o_orderkey", "o_orderstatus")
    return {
        "group_overlap_customers": _overlap(orders, "o_custkey", int_label),
        "group_overlap_users": _overlap(_stratified("events", "event_id", "event_type"), "user_id", int_label),
        "group_overlap_sources": _overlap(_stratified("documents", "doc_id", "lang"), "source", "id"),
        "shared_conversations": _overlap(_stratified(turns, "turn_id", "role"), "conv_id", int_label),
        "typed_group_ids": _overlap(mixed, "mixed_id", "CASE WHEN id.kind = 'str' THEN id.v ELSE 'int:' || id.v END"),
        "group_preview_customers": f"""
            SELECT label, CAST(greatest(total - 8, 0) AS BIGINT) AS n_more
            FROM (SELECT label, count(*) OVER () AS total FROM ({_overlap(orders, "o_custkey", int_label)}))
            ORDER BY label LIMIT 8""",
        "rows_of_shared_customers": f"""
            SELECT o_orderkey, o_custkey FROM {orders} WHERE split = 'test'
              AND o_custkey IN (SELECT o_custkey FROM {orders} WHERE split = 'train')""",
        "input_profile_lineitem": f"""
            SELECT split AS side, count(*) AS n_rows, count(*) FILTER ({lost}) AS rows_with_missing,
                   count(*) FILTER ({wild}) AS rows_with_nonfinite, {maxima}
            FROM {_dated("lineitem", "l_shipdate")} GROUP BY split""",
        "exact_match_lineitem": _line_match_sql(["l_quantity", "l_discount", "l_tax"], 1e-3),
        "near_match_lineitem": _line_match_sql(LINE_NUMERIC, 2.0),
        "near_match_repeated_ids": _line_match_sql(LINE_NUMERIC, 2.0),
        "near_match_orders": f"""
            SELECT test_id, train_id, round(d, 6) AS distance, CASE WHEN d <= 1e-8 THEN 'exact' ELSE 'near' END AS kind
            FROM ({_order_best(order_rows, 5.0)})""",
        "copied_documents": f"""
            WITH rows AS (SELECT * FROM {_stratified("documents", "doc_id", "lang")})
            SELECT q.doc_id AS test_id, min(t.doc_id) AS train_id, 'exact' AS kind
            FROM rows q JOIN rows t ON q.split = 'test' AND t.split = 'train' AND q.text = t.text AND q.lang = t.lang
            GROUP BY q.doc_id""",
        "near_embeddings": f"""
            WITH rows AS (SELECT * FROM {_stratified("embeddings", "vec_id", "label")}),
            pairs AS (SELECT q.vec_id AS test_id, t.vec_id AS train_id,
                             list_max(list_transform(range(1, 65),
                                 lambda i: abs(CAST(q.embedding[i] AS DOUBLE) - CAST(t.embedding[i] AS DOUBLE)))) AS d
                      FROM rows q JOIN rows t ON q.split = 'test' AND t.split = 'train'),
            best AS (SELECT test_id, arg_min(train_id, (d, train_id)) AS train_id, min(d) AS d FROM pairs
                     WHERE d <= 0.3 GROUP BY test_id)
            SELECT test_id, train_id, round(d, 6) AS distance, CASE WHEN d <= 1e-8 THEN 'exact' ELSE 'near' END AS kind
            FROM best""",
        "audit_summary_orders": _order_summary(order_rows, 5.0),
        "default_features_part": f"""
            WITH rows AS (SELECT * FROM {_stratified("part", "p_partkey", "p_type")}),
            best AS (SELECT q.p_partkey, min(greatest(abs(q.p_size - t.p_size), abs(q.p_retailprice - t.p_retailprice))) AS d
                     FROM rows q JOIN rows t ON q.split = 'test' AND t.split = 'train'
                      AND abs(q.p_size - t.p_size) <= 0.25 AND abs(q.p_retailprice - t.p_retailprice) <= 0.25
                     GROUP BY q.p_partkey)
            SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test,
                   'p_size,p_retailprice' AS feature_columns,
                   (SELECT count(*) FROM best WHERE d <= 1e-8) AS exact_duplicate_rows,
                   (SELECT count(*) FROM best WHERE d > 1e-8) AS near_duplicate_rows,
                   (SELECT count(*) FROM ({_overlap("rows", "p_brand", "id")})) AS n_overlapping_groups
            FROM rows""",
        "audit_both_splits_orders": f"""
            {_order_summary(by_row, 1.0, "'random' AS split_kind,")}
            UNION ALL {_order_summary(_grouped("orders", "o_custkey"), 1.0, "'group' AS split_kind,")}""",
        "csv_audit_orders": _order_summary(order_rows, 5.0),
        "csv_text_columns": f"""
            WITH rows AS (
                SELECT *, CASE o_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE CASE split WHEN 'test' THEN 'maybe' ELSE 'no' END END AS answer,
                       (o_custkey % 4) || CASE o_orderkey % 2 WHEN 0 THEN 'D' ELSE 'F' END AS code,
                       CASE o_orderkey % 5 WHEN 0 THEN strftime(date_trunc('month', o_orderdate), '%Y-%-m-%-d')
                                           ELSE strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') END AS month, o_custkey % 6 AS size
                FROM {by_row})
            SELECT q.o_orderkey AS test_id, min(t.o_orderkey) AS train_id, CAST(0 AS DOUBLE) AS distance, 'exact' AS kind
            FROM rows q JOIN rows t ON q.split = 'test' AND t.split = 'train' AND q.answer = t.answer AND q.code = t.code
              AND q.month = t.month AND q.size = t.size
            GROUP BY q.o_orderkey""",
        "json_mixed_ids": _overlap(
            f"""(SELECT *, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'float:' || (o_custkey % 900) || '.5'
                                               WHEN 2 THEN NULL ELSE 'int:' || o_custkey END AS ref FROM {order_rows})""",
            "ref", "id",
        ),
        "placed_matches_orders": f"""
            SELECT test_id AS o_orderkey, round(d, 6) AS distance, CASE WHEN d <= 1e-8 THEN 'exact' ELSE 'near' END AS kind, true AS names_match
            FROM ({_order_best(order_rows, 5.0)})""",
        "committed_findings_orders": f"""
            WITH s AS ({_order_summary(order_rows, 5.0)})
            SELECT 'summary' AS part, CAST(1 AS BIGINT) AS n_rows, exact_duplicate_rows + near_duplicate_rows AS total FROM s
            UNION ALL SELECT 'row_matches', exact_duplicate_rows + near_duplicate_rows, exact_duplicate_rows FROM s
            UNION ALL SELECT 'group_overlap', n_overlapping_groups, train_rows_with_overlapping_group FROM s""",
        "gate_orders": f"""
            SELECT exact_duplicate_rows, near_duplicate_rows, n_overlapping_groups, has_leakage FROM ({_order_summary(order_rows, 5.0)})""",
        "ordered_matches_orders": f"""
            SELECT row_number() OVER (ORDER BY test_id, train_id) - 1 AS position, test_id, train_id, round(d, 6) AS distance, 'near' AS kind
            FROM ({_order_best(order_rows, 5.0)}) WHERE d > 1e-8""",
        "rule_violations_lineitem": _violations_sql(),
        "violation_samples_lineitem": f"""
            SELECT side, "column", rule, max(n) AS n_rows, string_agg(id, ' ' ORDER BY place) AS sample
            FROM (SELECT *, row_number() OVER (PARTITION BY side, "column", rule ORDER BY md5('42|' || id), id) AS place,
                         count(*) OVER (PARTITION BY side, "column", rule) AS n
                  FROM (SELECT *, l_orderkey || '|' || l_linenumber AS id FROM ({_violations_sql()})))
            WHERE place <= 10 GROUP BY ALL""",
        "input_profile_broken_lineitem": f"""
            SELECT split AS side, count(*) AS n_rows,
                   count(*) FILTER (l_orderkey % 7 = 0 OR l_suppkey % 5 = 0 OR l_returnflag = 'R') AS rows_with_missing,
                   count(*) FILTER (l_partkey % 11 IN (0, 1)) AS rows_with_nonfinite
            FROM {_dated("lineitem", "l_shipdate")} GROUP BY split""",
        "stratified_split_orders": f"SELECT o_orderkey, split FROM {by_row}",
        "stratified_split_labels": f"SELECT doc_id, split FROM {_stratified('labels', 'doc_id', 'toxic')}",
        "group_split_orders": f"SELECT o_orderkey, split FROM {_grouped('orders', 'o_custkey')}",
        "encoding_map_sources": f"""
            WITH m AS (SELECT avg(quality) AS mean FROM {labelled})
            SELECT source AS code, round(CAST((sum(quality) + any_value(mean)) / (count(*) + 1) AS DOUBLE), 6) AS encoded,
                   count(*) AS n, round(any_value(mean), 6) AS overall_mean
            FROM {labelled}, m GROUP BY source""",
        "target_encoding_all": _encoding_sql("all"),
        "target_encoding_train": _encoding_sql("train"),
        "scaler_lineitem": " UNION ALL ".join(
            f"SELECT '{name}' AS \"column\", round(avg({name}), 6) AS mean, round(stddev_pop({name}), 6) AS std FROM lineitem"
            for name in LINE_NUMERIC
        ),
        "scaled_features_part": f"""
            WITH rows AS (SELECT * FROM {_grouped("part", "p_brand")}),
            s AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp, stddev_pop(p_retailprice) AS sp
                  FROM rows WHERE split = 'train')
            SELECT p_partkey, split, round((p_size - ms) / ss, 6) AS p_size_scaled,
                   round((p_retailprice - mp) / sp, 6) AS p_retailprice_scaled
            FROM rows, s""",
        "design_matrix_customer": """
            WITH rows AS (SELECT *, CAST(c_nationkey < 12 AS INTEGER) AS y FROM customer),
            m AS (SELECT avg(y) AS mean FROM rows),
            codes AS (SELECT c_mktsegment, (sum(y) + any_value(mean)) / (count(*) + 1) AS encoded FROM rows, m GROUP BY 1),
            e AS (SELECT c_custkey, c_acctbal, encoded FROM rows JOIN codes USING (c_mktsegment)),
            s AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(encoded) AS me, stddev_pop(encoded) AS se FROM e)
            SELECT c_custkey, round((c_acctbal - ma) / sa, 6) AS f0, round((encoded - me) / se, 6) AS f1 FROM e, s""",
        "binary_metrics_lineitem": _metrics_sql(leaky),
        "binary_metrics_ties": _metrics_sql(clean),
        "binary_metrics_labels": _metrics_sql(
            f"SELECT n_chars / (n_chars + 1000) AS score, toxic AS y FROM {labelled}"
        ),
        "metric_gap_lineitem": f"""
            SELECT round(a.accuracy - b.accuracy, 6) AS accuracy_gap, round(a.f1 - b.f1, 6) AS f1_gap,
                   round(a.roc_auc - b.roc_auc, 6) AS roc_auc_gap,
                   round(a.average_precision - b.average_precision, 6) AS average_precision_gap
            FROM ({_metrics_sql(leaky).replace(", 6)", ", 15)")}) a, ({_metrics_sql(clean).replace(", 6)", ", 15)")}) b""",
        "threshold_predict_lineitem": """
            SELECT CAST(l_quantity / 50 >= 0.5 AS INTEGER) AS predicted, CAST(l_returnflag = 'R' AS INTEGER) AS y,
                   count(*) AS n_rows
            FROM lineitem GROUP BY ALL""",
        "dataset_profile_orders": """
            SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups,
                   round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 6) AS positive_rate
            FROM orders""",
        "table_fingerprint_lineitem": _fingerprint_sql("lineitem", {
            "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
            "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
            "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
        }),
        "table_fingerprint_documents": _fingerprint_sql("documents", {
            "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint",
        }),
        "plant_leaks_recall": f"""
            WITH {_planted_ctes()}
            SELECT kind, count(*) AS planted, count(d) AS found,
                   count(*) FILTER (CASE WHEN d <= 1e-8 THEN 'exact' WHEN d IS NOT NULL THEN 'near' END = kind) AS found_as_planted
            FROM planted LEFT JOIN best ON o_orderkey = test_id WHERE kind <> 'group' GROUP BY kind""",
        "check_expectations_orders": f"""
            WITH {_planted_ctes()}
            SELECT *, expect_exact = exact_duplicate_rows AND expect_near = near_duplicate_rows
                      AND expect_groups = n_overlapping_groups AS passed
            FROM (SELECT 'orders' AS name, count(*) FILTER (kind = 'exact') AS expect_exact,
                         count(*) FILTER (kind = 'near') AS expect_near, count(*) FILTER (kind = 'group') AS expect_groups
                  FROM planted),
                 (SELECT count(*) FILTER (d <= 1e-8) AS exact_duplicate_rows,
                         count(*) FILTER (d > 1e-8) AS near_duplicate_rows FROM best),
                 (SELECT count(*) AS n_overlapping_groups FROM ({_overlap("rows", "o_custkey", int_label)}))""",
    }


# --- contract -------------------------------------------------------------------------------


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in _QUERIES}


def _training_data() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the optional subpackage for training data; none if it can't be imported."""
    try:
        from leakscan.llm import queries as training
    except ImportError:
        return {}, {}
    found, sql = training.queries(), training.oracle_sql()
    with contextlib.suppress(ImportError):
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core_queries() | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    return core_oracle_sql() | _training_data()[1]


def entry(spark: SparkSession) -> DataFrame:
    """Which customers are on both sides of a split of the orders, and with how many rows."""
    return group_overlap_customers(spark, SMOKE_DIR)
