"""Thresholds, exclusions and constraint rules.

Everything here is driver-side configuration: the values end up as literals in
Spark expressions, so none of it grows with the data.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from typing import Any

# The default thresholds a user of the profile expects.
DEFAULT_THRESHOLDS = {
    "missing_critical": 0.3,
    "missing_warning": 0.05,
    "outlier_threshold": 1.5,
    "skew_threshold": 1.0,
    "unique_threshold": 0.01,
    "zero_threshold": 0.8,
}

# Fractions live in [0, 1]; these two are multipliers and only need to be >= 0.
MULTIPLIERS = frozenset({"outlier_threshold", "skew_threshold"})

# Display limits of the report tables.
MAX_MISSING_COLUMNS = 10
MAX_CATEGORIES = 15


@dataclass(frozen=True)
class Config:
    """Settings of one analysis. Build it with :meth:`of` from a plain mapping."""

    missing_critical: float = DEFAULT_THRESHOLDS["missing_critical"]
    missing_warning: float = DEFAULT_THRESHOLDS["missing_warning"]
    outlier_threshold: float = DEFAULT_THRESHOLDS["outlier_threshold"]
    skew_threshold: float = DEFAULT_THRESHOLDS["skew_threshold"]
    unique_threshold: float = DEFAULT_THRESHOLDS["unique_threshold"]
    zero_threshold: float = DEFAULT_THRESHOLDS["zero_threshold"]
    exclude_values: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    missing_all_types: bool = False

    @classmethod
    def of(cls, config: Config | Mapping[str, Any] | None) -> Config:
        """Merge a user mapping over the defaults; unknown keys are ignored."""
        if config is None:
            return cls()
        if isinstance(config, Config):
            return config
        known = {f.name for f in fields(cls)}
        return replace(cls(), **{k: v for k, v in config.items() if k in known})

    def excluded(self, column: str) -> list[Any]:
        return list(self.exclude_values.get(column, ()))


def validate_thresholds(thresholds: Mapping[str, float]) -> dict[str, float]:
    """Defaults overlaid with the valid entries of ``thresholds``.

    Unknown names are dropped; a value out of range warns and keeps the default.
    """
    merged = dict(DEFAULT_THRESHOLDS)
    for name, value in thresholds.items():
        if name not in merged:
            continue
        in_range = value >= 0 if name in MULTIPLIERS else 0 <= value <= 1
        if in_range:
            merged[name] = value
        else:
            bound = "at least 0" if name in MULTIPLIERS else "between 0 and 1"
            warnings.warn(
                f"threshold {name}={value} must be {bound}; keeping {merged[name]}",
                stacklevel=2,
            )
    return merged


def split_rules(rules: Mapping[str, Any]) -> tuple[Config, dict[str, dict[str, Any]]]:
    """Split a rules mapping into a :class:`Config` and per-column constraints.

    Accepts ``{"thresholds": {...}, "column_rules": {...}}`` or a bare
    ``{column: {"min":, "max":, "allowed":}}`` mapping.
    """
    if "thresholds" in rules or "column_rules" in rules:
        config = Config.of(validate_thresholds(rules.get("thresholds") or {}))
        return config, dict(rules.get("column_rules") or {})
    return Config(), dict(rules)
