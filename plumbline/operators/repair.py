"""Repairs fitted on a reference table: median imputation and fence clipping."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.functions.columns import as_double, literal, numeric_columns, require
from plumbline.operators.rows import column_fences
from plumbline.plans.orderstats import quantiles


def fit_medians(ref: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians of the named numeric columns."""
    infos = numeric_columns(ref, columns)
    found = quantiles(ref, [(c.ordinal, as_double(c)) for c in infos], (0.5,))
    return {c.name: found[c.ordinal][0] for c in infos if c.ordinal in found}


def impute(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """Fill missing values; the columns become double."""
    filled = {
        name: F.expr(f"coalesce({as_double(require(df, name))}, {literal(float(median))})")
        for name, median in medians.items()
    }
    return df.withColumns(filled)


def fit_fences(ref: DataFrame, columns: list[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    """IQR fences of the named numeric columns."""
    infos = numeric_columns(ref, columns)
    found = column_fences(ref, infos, Config(outlier_threshold=k))
    return {c.name: found[c.ordinal] for c in infos if c.ordinal in found}


def clip(df: DataFrame, fences: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Limit values to the fences; missing ones stay missing. The columns become double."""
    clipped = {}
    for name, (lo, hi) in fences.items():
        value = as_double(require(df, name))
        limited = f"greatest({literal(float(lo))}, least({literal(float(hi))}, {value}))"
        clipped[name] = F.expr(f"CASE WHEN {value} IS NOT NULL THEN {limited} END")
    return df.withColumns(clipped)
