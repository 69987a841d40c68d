"""Problem rows: filters whose bounds are literals, so they reach the scan."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.functions.columns import (
    numeric_values,
    FLOATING,
    ColumnInfo,
    as_double,
    describe_columns,
    quoted,
    require,
    without,
)
from plumbline.plans.orderstats import quantiles

KINDS = ("missing_values", "outliers", "all")


def is_missing(info: ColumnInfo) -> Column:
    """NULL, or NaN in a floating column; written so that the scan can use it."""
    col = quoted(info.name)
    return (col.isNull() | F.isnan(col)) if isinstance(info.type, FLOATING) else col.isNull()


def column_fences(df: DataFrame, infos: list[ColumnInfo], config: Config) -> dict[int, tuple[float, float]]:
    """IQR fences per numeric column, excluded values left out, as driver numbers."""
    infos = [c for c in infos if c.family == "numeric"]
    if not infos:
        return {}
    entries = []
    for info in infos:
        entries.append((info.ordinal, without(as_double(info), config.excluded(info.name))))
    k = config.outlier_threshold
    found = quantiles(df, entries, (0.25, 0.75))
    return {i: (q1 - k * (q3 - q1), q3 + k * (q3 - q1)) for i, (q1, q3) in found.items()}


def is_outlier(info: ColumnInfo, bounds: tuple[float, float], config: Config) -> Column:
    """Outside the fences and not excluded. NaN compares as large, so it is ruled out."""
    col = quoted(info.name)
    out = (col < F.lit(bounds[0])) | (col > F.lit(bounds[1]))
    if isinstance(info.type, FLOATING):
        out = out & ~F.isnan(col)
    skip = numeric_values(config.excluded(info.name))
    return out & ~col.isin(skip) if skip else out


def _predicate(
    info: ColumnInfo, kind: str, fences: dict[int, tuple[float, float]], config: Config
) -> Column:
    parts = []
    if kind in ("missing_values", "all"):
        parts.append(is_missing(info))
    if kind in ("outliers", "all") and info.ordinal in fences:
        parts.append(is_outlier(info, fences[info.ordinal], config))
    return reduce(or_, parts) if parts else F.lit(False)


def problem_rows(
    df: DataFrame,
    column: str,
    issue_type: str = "all",
    config: Config | dict | None = None,
) -> DataFrame:
    """Rows whose ``column`` is missing, an outlier, or either. No row-count floor applies."""
    config = Config.of(config)
    info = require(df, column)
    fences = column_fences(df, [info], config) if issue_type in ("outliers", "all") else {}
    return df.filter(_predicate(info, issue_type, fences, config))


def any_problem_rows(
    df: DataFrame,
    columns: list[str],
    config: Config | dict | None = None,
    tag: str | None = None,
) -> DataFrame:
    """Rows with a problem in any of ``columns``: one pass, one predicate.

    With ``tag``, a column of that name lists the offending columns.
    """
    config = Config.of(config)
    infos = describe_columns(df, columns)
    fences = column_fences(df, infos, config)
    tests = [(c.name, _predicate(c, "all", fences, config)) for c in infos]
    if not tests:
        return df.limit(0)
    found = df.filter(reduce(or_, [t for _, t in tests]))
    if tag:
        names = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
        found = found.withColumn(tag, names)
    return found
