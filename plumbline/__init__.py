"""Data quality and drift on Spark."""

from plumbline.analysis import Analysis, analyze, quick_check
from plumbline.config import Config, split_rules, validate_thresholds
from plumbline.operators.constraints import constraint_report, constraint_rows
from plumbline.operators.drift import compare_profiles, drift_table, mean_changes
from plumbline.operators.sampling import sample_rows
from plumbline.sources.tables import load_table, write_table

__all__ = [
    "Analysis",
    "Config",
    "analyze",
    "compare_profiles",
    "constraint_report",
    "constraint_rows",
    "drift_table",
    "load_table",
    "mean_changes",
    "quick_check",
    "sample_rows",
    "split_rules",
    "validate_thresholds",
    "write_table",
]
