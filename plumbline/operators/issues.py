"""Quality issues: a function of the profile, the fences and the configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.functions.columns import ColumnInfo, as_double, literal, literal_frame, without
from plumbline.operators.profile import KEPT
from plumbline.plans.longform import melt

SEVERITIES = ("critical", "warning", "info")

# An outlier issue needs this many values, and is critical from this share on.
MIN_OUTLIER_VALUES = 10
CRITICAL_OUTLIER_PERCENT = 10.0
EXAMPLES = 5

# The message formats of the issues. Percentages have one decimal,
# other fractions two.
MESSAGES = {
    "missing_critical": "High percentage of missing values (%s%%)",
    "missing_warning": "Moderate percentage of missing values (%s%%)",
    "outliers": "Found %s outliers outside range [%s, %s]",
    "skewed_distribution": "Distribution is skewed (skewness = %s)",
    "low_cardinality": "Low cardinality: %s unique values for %s rows",
    "inconsistent_values": "Potential inconsistent values (different casing/spacing)",
    "future_dates": "Found %s future dates",
}

DETAILS = (
    ("threshold", "double"),
    ("lower_bound", "double"),
    ("upper_bound", "double"),
    ("min_value", "double"),
    ("max_value", "double"),
    ("skewness", "double"),
    ("unique_normalized_values", "long"),
    ("examples", "array<string>"),
)


def outlier_facts(
    df: DataFrame, infos: list[ColumnInfo], numeric: DataFrame, config: Config
) -> DataFrame:
    """Per numeric column: fences, outlier count and the farthest outliers.

    The fences (two numbers per column) come to the driver and go back as
    literals, so rows inside them are dropped in the scan stage. What is left
    is combined by value before the shuffle, and the ranking keeps five rows
    per task.
    """
    k = config.outlier_threshold
    # Key order puts a column's row without its excluded values last, so it wins.
    picked = numeric.filter("q1 IS NOT NULL").select("key", "n", "q1", "q3", "min", "max").collect()
    bounds = {r["key"] % KEPT: r for r in sorted(picked, key=lambda r: r["key"])}
    known = []
    for info in infos:
        r = bounds.get(info.ordinal)
        if r is not None:
            lo, hi = r["q1"] - k * (r["q3"] - r["q1"]), r["q3"] + k * (r["q3"] - r["q1"])
            known.append((info.ordinal, r["n"], lo, hi, r["min"], r["max"]))
    stats = literal_frame(
        df.sparkSession,
        known,
        "ordinal int, valid_count long, lower_bound double, upper_bound double, "
        "valid_min double, valid_max double",
    )
    by_ordinal = {c.ordinal: c for c in infos}
    entries, lows, highs = [], {}, {}
    for ordinal, n, lower, upper, *_ in known:
        if n >= MIN_OUTLIER_VALUES:
            info = by_ordinal[ordinal]
            entries.append((ordinal, without(as_double(info), config.excluded(info.name))))
            lows[ordinal], highs[ordinal] = literal(lower), literal(upper)
    if not entries:
        return stats.selectExpr(
            "*",
            "cast(NULL AS long) AS outlier_count",
            "cast(NULL AS array<string>) AS outlier_examples",
        )
    beyond = (
        melt(df, entries, {"lo": lows, "hi": highs}, key="ordinal")
        .filter("value < lo OR value > hi")
        .groupBy("ordinal", "value", F.expr("greatest(lo - value, value - hi) AS far"))
        .agg(F.expr("count(1) AS cnt"))
    )
    counts = beyond.groupBy("ordinal").agg(F.expr("sum(cnt) AS outlier_count"))
    examples = (
        beyond.selectExpr(
            "*", "row_number() OVER (PARTITION BY ordinal ORDER BY far DESC, value) AS place"
        )
        .filter(f"place <= {EXAMPLES}")
        .groupBy("ordinal")
        .agg(F.expr("sort_array(collect_list(struct(place, value))) AS found"))
        .selectExpr(
            "ordinal", "transform(found, x -> cast(x.value AS string)) AS outlier_examples"
        )
    )
    # One row per numeric column on every side.
    return stats.join(F.broadcast(counts), "ordinal", "left").join(
        F.broadcast(examples), "ordinal", "left"
    )


def _issue(kind: str, severity: str, message: str, count: str, percent: str, **details: str) -> str:
    """SQL text of one issue struct; absent details are typed NULLs."""
    cells = ", ".join(
        f"'{name}', cast({details.get(name, 'NULL')} AS {dtype})" for name, dtype in DETAILS
    )
    return (
        f"named_struct('issue_type', '{kind}', 'severity', {severity}, 'message', {message}, "
        f"'affected_count', cast({count} AS bigint), "
        f"'affected_percentage', cast({percent} AS double), 'details', named_struct({cells}))"
    )


def _text(kind: str, *args: str) -> str:
    return f"format_string('{', '.join([MESSAGES[kind] + chr(39), *args])})"


def _decimals(value: str, places: int) -> str:
    """Fixed decimals, rounded by the exact binary value; `format_string` would not."""
    return f"format_number({value}, '0.{'0' * places}')"


def find_issues(facts: DataFrame, config: Config) -> DataFrame:
    """Issues from the per-column facts: the profile, outlier facts and spelling groups.

    One row per column goes in; each check is a CASE on that row and the ones
    that fire become rows, in a fixed order per column.
    """
    number = "family IN ('numeric', 'boolean')"
    checked = "missing_count < total_count AND family IN ('numeric', 'boolean', 'text')"
    if config.missing_all_types:
        checked = "true"
    critical, warning = config.missing_critical * 100.0, config.missing_warning * 100.0

    def missing(severity: str, level: float) -> str:
        return _issue(
            "missing_values",
            f"'{severity}'",
            _text(f"missing_{severity}", _decimals("missing_percentage", 1)),
            "missing_count",
            "missing_percentage",
            threshold=f"CASE WHEN {number} THEN {level!r}D END",
        )

    share = "try_divide(outlier_count, valid_count) * 100"
    outliers = _issue(
        "outliers",
        f"CASE WHEN {share} < {CRITICAL_OUTLIER_PERCENT}D THEN 'warning' ELSE 'critical' END",
        _text("outliers", "outlier_count", _decimals("lower_bound", 2), _decimals("upper_bound", 2)),
        "outlier_count",
        share,
        lower_bound="lower_bound",
        upper_bound="upper_bound",
        min_value="valid_min",
        max_value="valid_max",
        examples="outlier_examples",
    )
    skewed = _issue(
        "skewed_distribution", "'info'", _text("skewed_distribution", _decimals("skew", 2)), "0", "0", skewness="skew"
    )
    ratio = "try_divide(unique_count, total_count)"
    narrow = _issue(
        "low_cardinality",
        "'info'",
        _text("low_cardinality", "unique_count", "total_count"),
        "unique_count",
        f"{ratio} * 100",
    )
    mixed = _issue(
        "inconsistent_values",
        "'warning'",
        f"'{MESSAGES['inconsistent_values']}'",
        "inconsistent_rows",
        "try_divide(inconsistent_rows, total_count) * 100",
        unique_normalized_values="spelling_groups",
        examples="spelling_examples",
    )
    future = _issue(
        "future_dates",
        "'warning'",
        _text("future_dates", "future_dates"),
        "future_dates",
        "try_divide(future_dates, total_count) * 100",
    )
    checks = f"""array(
        CASE WHEN {checked} AND missing_percentage > {critical!r}D THEN {missing("critical", critical)}
             WHEN {checked} AND missing_percentage > {warning!r}D THEN {missing("warning", warning)} END,
        CASE WHEN outlier_count > 0 THEN {outliers} END,
        CASE WHEN abs(skew) > {float(config.skew_threshold)!r}D THEN {skewed} END,
        CASE WHEN family = 'text' AND missing_count < total_count
              AND {ratio} < {float(config.unique_threshold)!r}D THEN {narrow} END,
        CASE WHEN inconsistent_groups > 0 THEN {mixed} END,
        CASE WHEN future_dates > 0 THEN {future} END)"""
    return (
        facts.selectExpr("column", f"explode(array_compact({checks})) AS issue")
        .select("column", "issue.*")
    )


def issues_by_severity(issues: DataFrame) -> DataFrame:
    """``severity, issues``: all three levels, zero included, from one aggregate row."""
    row = issues.agg(*[F.expr(f"count_if(severity = '{s}') AS {s}") for s in SEVERITIES])
    cells = ", ".join(f"named_struct('severity', '{s}', 'issues', {s})" for s in SEVERITIES)
    return row.selectExpr(f"inline(array({cells}))")


def issues_by_type(issues: DataFrame) -> DataFrame:
    """``issue_type, issues``: issues per type."""
    return issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("issues"))
