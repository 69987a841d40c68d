"""The tables behind the reports: recommendations, grade, score and issue context.

All inputs are profiles and issue tables, a few rows per column; rendering is
left to the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.issues import SEVERITIES
from plumbline.operators.profile import missing_totals

# The levels the recommendations react to.
MUCH_MISSING, SOME_MISSING = 20.0, 5.0
STRONG_SKEW = 1.5
SKEWED_SHOWN = 3

# The texts of the recommendations.
ADVICE = {
    "critical": "Address critical issues before proceeding with analysis.",
    "much_missing": "Consider data imputation or investigate sources of missing data.",
    "some_missing": "Review missing data patterns and consider appropriate handling methods.",
    "skewed": "Consider transformation for skewed columns: ",
    "good": "Data quality appears good. Proceed with analysis.",
}

# The health score's deductions and its gate.
CRITICAL_COST, OTHER_COST, PASS_SCORE = 10, 2, 80


def severity_row(issues: DataFrame) -> DataFrame:
    """One row: issues per severity."""
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def recommendations(profile: DataFrame, issues: DataFrame) -> DataFrame:
    """``rule, recommendation``: the advice that applies, in a fixed order."""
    skewed = F.when(F.abs("skew") > STRONG_SKEW, F.struct("ordinal", "column"))
    shape = profile.agg(
        F.lit(1).alias("one"),
        F.transform(
            F.slice(F.sort_array(F.collect_list(skewed)), 1, SKEWED_SHOWN), lambda c: c["column"]
        ).alias("skewed"),
    )
    totals = missing_totals(profile).select(F.lit(1).alias("one"), "total_missing_percentage")
    level = severity_row(issues).select(F.lit(1).alias("one"), "critical")
    row = level.join(F.broadcast(totals), "one").join(F.broadcast(shape), "one")  # one row each
    missing = F.col("total_missing_percentage")

    def advice(rule: str, extra=None):
        text = F.lit(ADVICE[rule]) if extra is None else F.concat(F.lit(ADVICE[rule]), extra)
        return F.struct(F.lit(rule).alias("rule"), text.alias("recommendation"))

    rules = F.array_compact(
        F.array(
            F.when(F.col("critical") > 0, advice("critical")),
            F.when(missing > MUCH_MISSING, advice("much_missing")).when(
                missing > SOME_MISSING, advice("some_missing")
            ),
            F.when(F.size("skewed") > 0, advice("skewed", F.array_join("skewed", ", "))),
        )
    )
    rules = F.when(F.size(rules) > 0, rules).otherwise(F.array(advice("good")))
    return row.select(F.inline(rules))


def quality_grade(issues: DataFrame) -> DataFrame:
    """``grade`` with the counts behind it: POOR, FAIR or GOOD."""
    grade = (
        F.when(F.col("critical") > 0, "POOR").when(F.col("warning") > 0, "FAIR").otherwise("GOOD")
    )
    return severity_row(issues).withColumn("grade", grade)


def health_score(issues: DataFrame) -> DataFrame:
    """``health_score`` out of 100 and whether the table passes the gate."""
    score = F.greatest(
        F.lit(0),
        100 - CRITICAL_COST * F.col("critical") - OTHER_COST * (F.col("total") - F.col("critical")),
    )
    return issues.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "critical").alias("critical")
    ).select(
        F.col("total").alias("total_issues"),
        F.col("critical").alias("critical_issues"),
        score.alias("health_score"),
        (score >= PASS_SCORE).alias("approved"),
    )


def issue_context(profile: DataFrame, issues: DataFrame) -> DataFrame:
    """Critical and warning issues beside the statistics of their column."""
    stats = profile.select(
        "column", "dtype", "mean", "median", "min", "max", "unique_count", "most_common"
    )
    found = issues.filter(F.col("severity").isin("critical", "warning")).select(
        "column",
        "issue_type",
        "severity",
        "affected_count",
        "affected_percentage",
        F.col("details.lower_bound").alias("lower_bound"),
        F.col("details.upper_bound").alias("upper_bound"),
        F.slice(F.col("details.examples"), 1, 3).alias("examples"),
    )
    return found.join(F.broadcast(stats), "column")  # one row per column
