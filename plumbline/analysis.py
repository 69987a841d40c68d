"""One analysis of a table: profile, issues, summary and problem rows.

The passes over the table run once and are kept as cached frames with one row
per column; everything else is derived from those.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.functions.columns import describe_columns
from plumbline.operators import issues as I
from plumbline.operators import profile as P
from plumbline.operators import rows as R
from plumbline.plans.frequency import spelling_examples


class Analysis:
    """The result of :func:`analyze`; nothing runs before it is asked for."""

    def __init__(
        self,
        df: DataFrame,
        name: str = "Dataset",
        config: Config | Mapping[str, Any] | None = None,
        as_of=None,
        approx_distinct: bool = False,
    ):
        self.df = df
        self.name = name
        self.config = Config.of(config)
        self.as_of = as_of
        self.approx_distinct = approx_distinct
        self.columns = describe_columns(df)

    def _family(self, *families: str):
        return [c for c in self.columns if c.family in families]

    @property
    def _excluded(self) -> dict[str, list]:
        return {c.name: self.config.excluded(c.name) for c in self.columns}

    @cached_property
    def rows(self) -> int:
        return self.df.count()

    @cached_property
    def _facts(self) -> DataFrame:
        return P.column_facts(self.df, self.as_of, self._excluded, self.approx_distinct)

    @cached_property
    def profile(self) -> DataFrame:
        """One row per column; cached, it is as long as the schema is wide."""
        return P.profile(self.df, self.as_of, self._excluded, self.rows, self._facts).persist()

    @cached_property
    def facts(self) -> DataFrame:
        """The profile with what the issue checks need besides."""
        facts, have = self.profile, set(self._facts.columns)
        extra = {
            "valid_count": "long", "lower_bound": "double", "upper_bound": "double",
            "valid_min": "double", "valid_max": "double", "outlier_count": "long",
            "outlier_examples": "array<string>", "spelling_groups": "long",
            "inconsistent_groups": "long", "inconsistent_rows": "long",
            "spelling_examples": "array<string>",
        }
        # Every frame joined here has at most one row per column of the input.
        if self._family("numeric"):
            numbers = I.outlier_facts(self.df, self._family("numeric"), self._facts, self.config)
            facts = facts.join(F.broadcast(numbers), "ordinal", "left")
        if "spelling_groups" in have:
            groups = self._facts.filter("spelling_groups IS NOT NULL").selectExpr(
                "key AS ordinal", "spelling_groups", "inconsistent_groups", "inconsistent_rows"
            )
            facts = facts.join(F.broadcast(groups), "ordinal", "left")
            hit = {r["ordinal"] for r in groups.filter("inconsistent_groups > 0").collect()}
            mixed = [c for c in self._family("text") if c.ordinal in hit]
            if mixed:
                shown = spelling_examples(self.df, mixed, self._excluded).selectExpr(
                    "key AS ordinal", "examples AS spelling_examples"
                )
                facts = facts.join(F.broadcast(shown), "ordinal", "left")
        absent = [f"cast(NULL AS {t}) AS {c}" for c, t in extra.items() if c not in facts.columns]
        return facts.selectExpr("*", *absent)

    @cached_property
    def issues(self) -> DataFrame:
        """The quality issues; cached, a handful of rows per column at most."""
        return I.find_issues(self.facts, self.config).persist()

    def summary(self) -> DataFrame:
        """One row: shape, issue counts, column types and the missing-data overview."""
        return summary(self)

    def column_report(self, column: str) -> DataFrame | None:
        """The profile row of one column with its issues; None if there is no such column."""
        if column not in self.df.columns:
            return None
        found = (
            self.issues.filter(F.col("column") == column)
            .groupBy("column")
            .agg(
                F.collect_list(
                    F.struct(
                        "issue_type", "severity", "message", "affected_count", "affected_percentage"
                    )
                ).alias("issues")
            )
        )
        return self.profile.filter(F.col("column") == column).join(found, "column", "left")

    def problem_rows(self, column: str, issue_type: str = "all") -> DataFrame:
        """The rows of the table that are missing, outliers, or either, in one column."""
        return R.problem_rows(self.df, column, issue_type, self.config)

    def any_problem_rows(self) -> DataFrame:
        """The rows with a problem in any column that has an issue."""
        hit = [r["column"] for r in self.issues.select("column").distinct().collect()]
        return R.any_problem_rows(self.df, hit, self.config)


def analyze(
    df: DataFrame,
    name: str = "Dataset",
    config: Config | Mapping[str, Any] | None = None,
    as_of=None,
    approx_distinct: bool = False,
) -> Analysis:
    """Profile a table and find its quality issues.

    With ``approx_distinct`` no value is shuffled to be counted: distinct counts are
    estimates, and entropy and spelling groups are left out.
    """
    return Analysis(df, name, config, as_of, approx_distinct)


def quick_check(df: DataFrame, name: str = "Dataset", as_of=None) -> DataFrame:
    """The one-row summary of a table under the default settings."""
    return analyze(df, name, as_of=as_of).summary()


def summary(analysis: Analysis) -> DataFrame:
    """Assemble the summary row from the one-row and few-row tables it is made of."""
    one = F.lit(1).alias("one")
    shape = P.dataset_shape(analysis.df).select(
        one, F.lit(analysis.name).alias("dataset"), "rows", "columns", "total_cells", "size_bytes"
    )
    issues = analysis.issues
    severity = issues.agg(
        F.lit(1).alias("one"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in I.SEVERITIES],
    )
    kinds = (
        I.issues_by_type(issues)
        .groupBy(one)
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("issue_type", "issues")))).alias("issues_by_type"))
    )
    types = (
        P.type_counts(analysis.df)
        .groupBy(one)
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "columns")))).alias("column_types"))
    )
    totals = P.missing_totals(analysis.profile).select(one, "*")
    entry = F.struct(
        (-F.col("missing_percentage")).alias("order"),
        "ordinal",
        "column",
        "missing_count",
        "missing_percentage",
    )
    top = (
        analysis.profile.filter("missing_count > 0")
        .groupBy(one)
        .agg(F.slice(F.sort_array(F.collect_list(entry)), 1, P.MAX_MISSING_COLUMNS).alias("found"))
        .select(
            "one",
            F.transform(
                "found",
                lambda x: F.struct(x["column"].alias("column"), x["missing_count"].alias("missing_count"), x["missing_percentage"].alias("missing_percentage")),
            ).alias("missing_columns"),
        )
    )
    out = shape
    for part in (severity, kinds, types, totals, top):  # one row each
        out = out.join(F.broadcast(part), "one", "left")
    return out.drop("one")
