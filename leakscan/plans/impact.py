"""How much a leaky protocol inflates scores: the same models under leaky and clean preparation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from leakscan.operators.metrics import METRICS, binary_metrics, dataset_profile, metric_gap
from leakscan.operators.prepare import (
    POPULATIONS,
    apply_scaler,
    apply_target_encoding,
    design_matrix,
    fit_rows,
    fit_scaler,
    fit_target_encoding,
)
from leakscan.operators.splits import group_split, stratified_row_split
from leakscan.plans.audit import audit_both_splits
from leakscan.scratch import claim, discard, materialize
from leakscan.settings import (
    DEFAULT_SEED,
    FOREST_BINS,
    FOREST_DEPTH,
    FOREST_TREES,
    LOGISTIC_C,
    LOGISTIC_MAX_ITER,
    TEST_SHARE,
)

ROW_SPLIT, GROUP_SPLIT = "_row_split", "_group_split"
TRAIN_PARTITION_ROWS = 50_000


@dataclass(frozen=True)
class Protocol:
    """One way to split, prepare and score. ``columns`` is ``clinical`` or ``wide``."""

    key: str
    title: str
    split: str
    fit: str
    model: str = "logistic regression"
    columns: str = "clinical"
    encoded: bool = True


# The keys, split, fit and model names by which scores are looked up.
PROTOCOLS = (
    Protocol("leaky", "Both leaks: row split, preparation sees every row", "random", "all"),
    Protocol("group_leak", "Shared entities only: row split, preparation sees train", "random", "train"),
    Protocol("preprocess_leak", "Preparation leak only: group split, preparation sees every row", "group", "all"),
    Protocol("clean", "No leak: group split, preparation sees train", "group", "train"),
    Protocol("clinical_only", "No identifier: group split, numeric features", "group", "train", encoded=False),
    Protocol("forest_random", "Forest on a row split", "random", "train", "random forest", "wide", False),
    Protocol("forest_group", "Forest on a group split", "group", "train", "random forest", "wide", False),
)
SCALER_PROTOCOLS = (
    Protocol("scaler_all", "Group split, scaler sees every row", "group", "all", encoded=False),
    Protocol("scaler_train", "Group split, scaler sees train", "group", "train", encoded=False),
)


@dataclass(frozen=True)
class ImpactInput:
    """The roles of the columns of the table under study."""

    id_column: str
    group: str
    target: str
    code: str
    numeric: tuple[str, ...]
    fingerprint: tuple[str, ...] = ()


@dataclass(frozen=True)
class ModelSettings:
    """Model parameters; the defaults are the ones the protocols are defined with."""

    trees: int = FOREST_TREES
    depth: int = FOREST_DEPTH
    bins: int = FOREST_BINS
    c: float = LOGISTIC_C
    max_iter: int = LOGISTIC_MAX_ITER
    seed: int = DEFAULT_SEED
    parallelism: int = 3


@dataclass(frozen=True)
class Impact:
    """Results as DataFrames. ``scores``: one row per protocol."""

    profile: DataFrame
    audits: DataFrame
    scores: DataFrame
    gap: DataFrame
    scaler_delta: DataFrame

    def score(self, key: str):
        """The score row of one protocol; ``KeyError`` for a key that was not run."""
        row = self.scores.where(F.col("key") == key).first()
        if row is None:
            raise KeyError(key)
        return row


def split_both_ways(
    table: DataFrame, roles: ImpactInput, seed: int = DEFAULT_SEED, share: float = TEST_SHARE
) -> DataFrame:
    """The table with a row split and a group split, written once for all protocols."""
    rows = stratified_row_split(table, roles.id_column, roles.target, seed, share, ROW_SPLIT)
    return materialize(group_split(rows, roles.group, seed, share, GROUP_SPLIT), "splits")


def prepare(table: DataFrame, roles: ImpactInput, protocol: Protocol) -> DataFrame:
    """``y``, ``split``, ``id`` and the scaled ``features`` of every row under one protocol."""
    split = {"random": ROW_SPLIT, "group": GROUP_SPLIT}[protocol.split]
    columns = list(roles.numeric + (roles.fingerprint if protocol.columns == "wide" else ()))
    needed = dict.fromkeys([roles.id_column, roles.target, split, *columns, *([roles.code] if protocol.encoded else [])])
    rows = table.select(*[F.col(f"`{name}`") for name in needed])
    if protocol.encoded:
        seen = fit_rows(rows, protocol.fit, split)
        encoding, mean = fit_target_encoding(seen, roles.code, roles.target)
        rows = apply_target_encoding(rows, encoding, mean, roles.code, "_encoded_code")
        columns.append("_encoded_code")
    scaler = fit_scaler(fit_rows(rows, protocol.fit, split), columns)
    scaled = apply_scaler(rows, scaler)
    return design_matrix(scaled, [f"{name}_scaled" for name in columns]).select(
        F.col(f"`{roles.target}`").cast("double").alias("y"),
        F.col(split).alias("split"),
        F.col(f"`{roles.id_column}`").alias("id"),
        "features",
    )


def _estimator(protocol: Protocol, n_train: int, settings: ModelSettings) -> Estimator:
    if protocol.model == "logistic regression":
        # Spark divides the loss by the number of rows; dividing C likewise keeps the same optimum.
        return LogisticRegression(
            labelCol="y",
            regParam=1.0 / (settings.c * n_train),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=settings.max_iter,
            tol=1e-10,
        )
    return RandomForestClassifier(
        labelCol="y", numTrees=settings.trees, maxDepth=settings.depth, maxBins=settings.bins, seed=settings.seed
    )


def _without_summary(model: Model, spark: SparkSession) -> Model:
    """The same model, saved and loaded again.

    The summary of a fitted model holds the session, which its scoring function would take to the executors. A session in
    which a job was observed cannot be serialized (Spark 4.1), so scoring would fail there.
    """
    path = claim(spark, "model")
    model.write().save(path)
    loaded = type(model).load(path)
    discard(path)
    return loaded


def score_model(prepared: DataFrame, protocol: Protocol, settings: ModelSettings = ModelSettings()) -> DataFrame:
    """Fit on train, score test: one row with the four metrics and both sizes."""
    prepared = materialize(prepared, "prepared")
    train = prepared.where(F.col("split") == "train")
    n_train = train.count()
    if protocol.model == "random forest":
        # Bootstrap draws depend on row order, so partitions and their order are fixed by id.
        parts = -(-n_train // TRAIN_PARTITION_ROWS)
        train = train.repartition(parts, "id").sortWithinPartitions("id")
    model = _without_summary(_estimator(protocol, n_train, settings).fit(train), prepared.sparkSession)
    test = prepared.where(F.col("split") == "test")
    scored = model.transform(test).select(vector_to_array("probability")[1].alias("score"), "y")
    metrics = binary_metrics(scored)
    discard(prepared)
    return metrics.select(
        F.lit(protocol.key).alias("key"),
        F.lit(protocol.title).alias("title"),
        F.lit(protocol.split).alias("split"),
        F.lit(POPULATIONS[protocol.fit]).alias("fit"),
        F.lit(protocol.model).alias("model"),
        *METRICS,
        F.lit(n_train).cast("bigint").alias("n_train"),
        F.col("n_rows").alias("n_test"),
    )


def score_protocols(
    split_table: DataFrame,
    roles: ImpactInput,
    protocols: Sequence[Protocol] = PROTOCOLS,
    settings: ModelSettings = ModelSettings(),
) -> DataFrame:
    """One score row per protocol. A few protocols run at a time, because a single fit leaves executors idle."""

    @inheritable_thread_target(split_table.sparkSession)
    def run(protocol: Protocol) -> DataFrame:
        return score_model(prepare(split_table, roles, protocol), protocol, settings)

    with ThreadPool(max(1, min(settings.parallelism, len(protocols)))) as pool:
        rows = pool.map(run, protocols)
    return reduce(DataFrame.unionByName, rows)


def scaler_only_delta(
    split_table: DataFrame, roles: ImpactInput, settings: ModelSettings = ModelSettings()
) -> DataFrame:
    """One row: ROC-AUC with the scaler fitted on all rows minus fitted on train, group split, no encoder."""
    scores = score_protocols(split_table, roles, SCALER_PROTOCOLS, settings)
    return metric_gap(scores, "scaler_all", "scaler_train", ("roc_auc",)).withColumnRenamed(
        "roc_auc_gap", "scaler_only_auc_delta"
    )


def leakage_impact(
    table: DataFrame,
    roles: ImpactInput,
    seed: int = DEFAULT_SEED,
    share: float = TEST_SHARE,
    protocols: Sequence[Protocol] = PROTOCOLS,
    settings: ModelSettings | None = None,
    **audit_options,
) -> Impact:
    """Split both ways, audit both splits, score every protocol, and take the differences."""
    settings = settings or ModelSettings(seed=seed)
    split_table = split_both_ways(table, roles, seed, share)
    features = [*roles.numeric, *roles.fingerprint, roles.code]
    audit_table = split_table.withColumnsRenamed({ROW_SPLIT: "row", GROUP_SPLIT: "group"})
    audits = audit_both_splits(
        audit_table, features, roles.group, {"random": "row", "group": "group"},
        id_columns=[roles.id_column], **audit_options,
    )
    scores = materialize(score_protocols(split_table, roles, protocols, settings), "scores")
    return Impact(
        dataset_profile(table, roles.group, roles.target),
        audits,
        scores,
        metric_gap(scores),
        scaler_only_delta(split_table, roles, settings),
    )
