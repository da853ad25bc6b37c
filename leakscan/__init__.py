"""Find leakage between train and test tables, and measure what it does to scores, on Spark."""

from leakscan.errors import InputError, LeakageFound
from leakscan.operators.features import column_kinds, require_same_kinds, resolve_features
from leakscan.operators.fingerprint import table_fingerprint
from leakscan.operators.match import SearchLimits, find_matches
from leakscan.operators.metrics import binary_metrics, dataset_profile, metric_gap, threshold_predict
from leakscan.operators.overlap import group_overlap, group_preview, ordered_groups, rows_in_overlap
from leakscan.operators.plant import plant_leaks, recall
from leakscan.operators.positions import with_position
from leakscan.operators.prepare import (
    apply_scaler,
    apply_target_encoding,
    design_matrix,
    fit_rows,
    fit_scaler,
    fit_target_encoding,
)
from leakscan.operators.quarantine import rule_violations, violation_samples
from leakscan.operators.splits import group_split, stratified_row_split
from leakscan.operators.validate import input_profile
from leakscan.plans.audit import (
    SplitAudit,
    audit_both_splits,
    audit_job,
    audit_split,
    audit_splits,
    check_expectations,
    require_clean,
)
from leakscan.plans.impact import (
    PROTOCOLS,
    Impact,
    ImpactInput,
    ModelSettings,
    Protocol,
    leakage_impact,
    scaler_only_delta,
    score_model,
    score_protocols,
)
from leakscan.scratch import release_scratch
from leakscan.sources import Findings, SplitPair, WrittenFindings, expand_vectors, read_findings, read_pair, split_pair, write_findings

__all__ = [
    "Findings",
    "Impact",
    "ImpactInput",
    "InputError",
    "LeakageFound",
    "ModelSettings",
    "PROTOCOLS",
    "Protocol",
    "SearchLimits",
    "SplitAudit",
    "SplitPair",
    "WrittenFindings",
    "apply_scaler",
    "apply_target_encoding",
    "audit_both_splits",
    "audit_splits",
    "audit_job",
    "audit_split",
    "binary_metrics",
    "check_expectations",
    "column_kinds",
    "dataset_profile",
    "design_matrix",
    "expand_vectors",
    "find_matches",
    "fit_rows",
    "fit_scaler",
    "fit_target_encoding",
    "group_overlap",
    "group_preview",
    "group_split",
    "input_profile",
    "leakage_impact",
    "metric_gap",
    "ordered_groups",
    "plant_leaks",
    "read_findings",
    "read_pair",
    "recall",
    "release_scratch",
    "require_clean",
    "require_same_kinds",
    "resolve_features",
    "rows_in_overlap",
    "rule_violations",
    "scaler_only_delta",
    "score_model",
    "score_protocols",
    "split_pair",
    "stratified_row_split",
    "table_fingerprint",
    "threshold_predict",
    "violation_samples",
    "with_position",
    "write_findings",
]
