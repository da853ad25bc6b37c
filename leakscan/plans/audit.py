"""The audit of one split, of both splits of a table, and of files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from leakscan.errors import LeakageFound
from leakscan.functions.variants import typed_variants
from leakscan.operators.features import resolve_features
from leakscan.operators.match import Matches, SearchLimits, find_matches
from leakscan.operators.match_splits import find_matches_of_splits
from leakscan.operators.overlap import OVERLAP_SCHEMA, group_overlap, group_preview, overlap_of_split, shared_ids_of_splits
from leakscan.operators.positions import with_position
from leakscan.operators.validate import check_schema
from leakscan.scratch import materialize
from leakscan.settings import EXACT_ATOL, GROUP_RULE, NEAR_ATOL, PREVIEW_SIZE
from leakscan.sources.findings import write_findings
from leakscan.sources.pair import SplitPair, known_side
from leakscan.sources.tables import read_pair


@dataclass(frozen=True)
class SplitAudit:
    """Findings as DataFrames.

    ``summary``: one row. ``row_matches``: ``test_id, train_id, distance, kind``, one row per
    matched test row. ``group_overlap``: ``label, n_train, n_test``, one row per shared id.
    """

    matches: Matches
    summary: DataFrame
    row_matches: DataFrame
    group_overlap: DataFrame

    def ordered_matches(self, kind: str) -> DataFrame:
        """Matches of one kind by test id, then train id."""
        return self.row_matches.where(F.col("kind") == kind).orderBy("test_id", "train_id")

    def positioned_matches(self, kind: str) -> DataFrame:
        """The same with the place of each match in a column ``position``, from 0; the order is not made in one task."""
        return with_position(self.row_matches.where(F.col("kind") == kind), ["test_id", "train_id"])

    def preview(self, size: int = PREVIEW_SIZE) -> DataFrame:
        return group_preview(self.group_overlap, size)

    def has_leakage(self) -> bool:
        return self.summary.first()["has_leakage"]


def audit_split(
    pair: SplitPair,
    features: Sequence[str],
    group: str | None = None,
    near_atol: float = NEAR_ATOL,
    exact_atol: float = EXACT_ATOL,
    id_columns: Sequence[str] = (),
    limits: SearchLimits = SearchLimits(),
) -> SplitAudit:
    """Audit the test side of ``pair`` against its train side.

    A test row matches a train row that equals it in every categorical feature and lies
    within ``near_atol`` in the largest numeric difference; up to ``exact_atol`` the match
    is exact. Group ids on both sides are reported whether or not rows match. Give
    ``id_columns`` to have matches named by row; else they are named by feature vector.
    """
    features = tuple(features)
    numeric, categorical = check_schema(pair, features, group, near_atol, exact_atol)
    matches = find_matches(pair, numeric, categorical, near_atol, exact_atol, id_columns, limits)
    if group is None:
        overlap = pair.train.sparkSession.createDataFrame([], OVERLAP_SCHEMA)
    else:
        overlap = materialize(group_overlap(pair, group), "group_overlap")
    return SplitAudit(
        matches,
        _summary(matches, overlap, features, group, near_atol, exact_atol),
        matches.rows(),
        overlap,
    )


def _summary(
    matches: Matches,
    overlap: DataFrame,
    features: Sequence[str],
    group: str | None,
    near_atol: float,
    exact_atol: float,
) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    copied = matches.counts().select(
        "exact_duplicate_rows", "near_duplicate_rows", zero.alias("_g"), zero.alias("_tr"), zero.alias("_te")
    )
    shared = overlap.agg(
        F.count(F.lit(1)).alias("_g"), F.sum("n_train").alias("_tr"), F.sum("n_test").alias("_te")
    ).select(zero.alias("exact_duplicate_rows"), zero.alias("near_duplicate_rows"), "_g", "_tr", "_te")
    totals = copied.unionByName(shared).agg(
        F.sum("exact_duplicate_rows").alias("exact_duplicate_rows"),
        F.sum("near_duplicate_rows").alias("near_duplicate_rows"),
        F.sum("_g").alias("n_overlapping_groups"),
        F.coalesce(F.sum("_tr"), zero).alias("train_rows_with_overlapping_group"),
        F.coalesce(F.sum("_te"), zero).alias("test_rows_with_overlapping_group"),
    )
    found = F.greatest("exact_duplicate_rows", "near_duplicate_rows", "n_overlapping_groups") > 0
    return totals.select(
        F.lit(matches.checked.n_train).cast("bigint").alias("n_train"),
        F.lit(matches.checked.n_test).cast("bigint").alias("n_test"),
        F.array(*map(F.lit, features)).alias("feature_columns"),
        F.lit(group).cast("string").alias("group_column"),
        F.lit(float(exact_atol)).alias("exact_atol"),
        F.lit(float(near_atol)).alias("near_atol"),
        "exact_duplicate_rows",
        "near_duplicate_rows",
        "n_overlapping_groups",
        F.lit(GROUP_RULE if group else None).cast("string").alias("group_equality_rule"),
        "train_rows_with_overlapping_group",
        "test_rows_with_overlapping_group",
        found.alias("has_leakage"),
    )


def require_clean(summary: DataFrame) -> None:
    """Raise ``LeakageFound`` so that the pipeline that asked stops here."""
    row = summary.first()
    if row["has_leakage"]:
        raise LeakageFound(row)


def audit_splits(
    table: DataFrame,
    features: Sequence[str],
    split_columns: dict[str, str],
    group: str | None = None,
    near_atol: float = NEAR_ATOL,
    exact_atol: float = EXACT_ATOL,
    id_columns: Sequence[str] = (),
    limits: SearchLimits = SearchLimits(),
) -> dict[str, SplitAudit]:
    """The audits of several splits of one table, with one scan and one shuffle for row matches and one of each for groups.

    ``split_columns`` maps a name to the column that holds ``train`` or ``test``; other values stop the audit. Rows, checks
    and results are those of ``audit_split`` on each split.
    """
    features, table = tuple(features), typed_variants(table)
    bare = table.drop(*split_columns.values())
    numeric, categorical = check_schema(SplitPair(bare, bare), features, group, near_atol, exact_atol)
    sides = [known_side(table, column, "train", "test") == "train" for column in split_columns.values()]
    found = find_matches_of_splits(table, sides, numeric, categorical, near_atol, exact_atol, id_columns, limits)
    shared = None if group is None else materialize(shared_ids_of_splits(table, sides, group), "shared_ids")
    audits = {}
    for number, (kind, matches) in enumerate(zip(split_columns, found, strict=True)):
        overlap = table.sparkSession.createDataFrame([], OVERLAP_SCHEMA) if shared is None else overlap_of_split(shared, number)
        audits[kind] = SplitAudit(
            matches, _summary(matches, overlap, features, group, near_atol, exact_atol), matches.rows(), overlap
        )
    return audits


def audit_both_splits(
    table: DataFrame, features: Sequence[str], group: str, split_columns: dict[str, str], **options
) -> DataFrame:
    """Summaries of several splits of one table, with the name of the split in ``split_kind``; see ``audit_splits``."""
    result = None
    for kind, audit in audit_splits(table, features, split_columns, group, **options).items():
        row = audit.summary.select(F.lit(kind).alias("split_kind"), "*")
        result = row if result is None else result.unionByName(row)
    return result


def audit_job(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    features: str | Sequence[str] | None = None,
    group: str | None = None,
    target: str | None = None,
    near_atol: float = NEAR_ATOL,
    exact_atol: float = EXACT_ATOL,
    id_columns: Sequence[str] = (),
    output: str | None = None,
    mode: str = "errorifexists",
    strict: bool = False,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    row_ids: str | None = None,
    **options: object,
) -> SplitAudit:
    """Read a pair, pick the features, audit, write the findings, and stop if ``strict``.

    Id columns are not features unless they are named in ``features``. With ``row_ids`` rows are named by file and place,
    see ``read_pair``. With ``output`` the verdict comes from the job that writes the findings, which are there when it stops.
    """
    pair = read_pair(spark, train_path, test_path, fmt, schema, row_ids=row_ids, **options)
    id_columns = [*id_columns, *([row_ids] if row_ids else [])]
    chosen = resolve_features(pair, features, group, target)
    if not features:
        chosen = [name for name in chosen if name not in set(id_columns)]
    audit = audit_split(pair, chosen, group, near_atol, exact_atol, id_columns)
    if output is not None:
        written = write_findings(audit, output, mode)
        if strict and written.summary["has_leakage"]:
            raise LeakageFound(written.summary)
    elif strict:
        require_clean(audit.summary)
    return audit


def check_expectations(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed and planted counts side by side, and whether they agree.

    ``observed``: ``name`` plus summary columns, and ``group_labels`` (sorted array) when ids are
    to be compared too. ``expected``: ``name, expect_exact, expect_near`` and ``expect_groups``,
    a count or a sorted array of labels.
    """
    pairs = (("expect_exact", "exact_duplicate_rows"), ("expect_near", "near_duplicate_rows"))
    by_label = isinstance(expected.schema["expect_groups"].dataType, T.ArrayType)
    groups = F.col("group_labels") if by_label else F.col("n_overlapping_groups")
    agrees = groups.eqNullSafe(F.col("expect_groups"))
    for wanted, seen in pairs:
        agrees = agrees & F.col(seen).eqNullSafe(F.col(wanted))
    return expected.join(observed, "name", "left").select(
        *expected.columns,
        "exact_duplicate_rows",
        "near_duplicate_rows",
        "n_overlapping_groups",
        agrees.alias("passed"),
    )
