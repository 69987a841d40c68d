"""Column constraints: inclusive ranges and allowed sets."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import clean, require
from plumbline.functions.stats import percentage


def rules_from_table(table: DataFrame) -> dict[str, dict[str, Any]]:
    """Rules from ``column, kind, args``: kind min, max (one number) or allowed (a list).

    ``args`` is an array of strings. A rules table is configuration: it is read
    to the driver and used as literals. For a set that grows with the data see
    :func:`not_in_reference`.
    """
    rules: dict[str, dict[str, Any]] = {}
    for row in table.collect():
        args = list(row["args"])
        value = args if row["kind"] == "allowed" else float(args[0])
        rules.setdefault(row["column"], {})[row["kind"]] = value
    return rules


def _checks(df: DataFrame, rules: Mapping[str, Mapping[str, Any]]) -> list[tuple[str, str, Column, Column]]:
    """``column, constraint, present value, violated`` per rule; absent columns are skipped."""
    checks = []
    for column, rule in rules.items():
        if column not in df.columns:
            continue
        value = F.expr(clean(require(df, column)))
        low, high = rule.get("min"), rule.get("max")
        if low is not None or high is not None:
            bad = [value < F.lit(low)] if low is not None else []
            bad += [value > F.lit(high)] if high is not None else []
            checks.append((column, "range", value, reduce(or_, bad)))
        if rule.get("allowed") is not None:
            checks.append((column, "allowed", value, ~value.isin(list(rule["allowed"]))))
    return checks


def constraint_report(df: DataFrame, rules: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """``column, constraint, checked_count, violations, violation_percentage``: one scan."""
    checks = _checks(df, rules)
    if not checks:
        return df.sparkSession.createDataFrame(
            [],
            "column string, constraint string, checked_count long, violations long, "
            "violation_percentage double",
        )
    aggs, cells = [], []
    for i, (column, kind, value, bad) in enumerate(checks):
        aggs += [F.count(value).alias(f"n{i}"), F.count_if(bad).alias(f"bad{i}")]
        cells.append(
            F.struct(
                F.lit(column).alias("column"),
                F.lit(kind).alias("constraint"),
                F.col(f"n{i}").alias("checked_count"),
                F.col(f"bad{i}").alias("violations"),
                F.expr(percentage(f"bad{i}", f"n{i}")).alias("violation_percentage"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def constraint_rows(
    df: DataFrame, rules: Mapping[str, Mapping[str, Any]], tag: str | None = None
) -> DataFrame:
    """Rows that violate any rule; with ``tag``, a column listing the columns that do."""
    checks = _checks(df, rules)
    if not checks:
        return df.limit(0)
    found = df.filter(reduce(or_, [bad for *_, bad in checks]))
    if tag:
        names = F.array(*[F.when(bad, F.lit(column)) for column, _, _, bad in checks])
        found = found.withColumn(tag, F.array_distinct(F.array_compact(names)))
    return found


def not_in_reference(df: DataFrame, column: str, allowed: DataFrame, allowed_column: str) -> DataFrame:
    """Rows whose present ``column`` is not among the values of another table.

    The join side is chosen from its size at run time; nothing is forced.
    """
    value = F.expr(clean(require(df, column)))
    keys = allowed.select(F.col(allowed_column).alias("__allowed")).distinct()
    return df.filter(value.isNotNull()).join(keys, F.col(column) == F.col("__allowed"), "left_anti")


def _rule_columns(df: DataFrame, rules: DataFrame) -> tuple[dict[str, dict[str, str]], list[str]]:
    """Tightest range and columns with an allowed set: a row per column of ``df``, whatever the number of rules."""
    own = rules.filter(F.col("column").isin(df.columns))
    number = F.expr("try_cast(get(args, 0) AS double)")
    ranges = {}
    found = own.groupBy("column").agg(
        F.max(F.when(F.col("kind") == "min", number)).alias("min"),
        F.min(F.when(F.col("kind") == "max", number)).alias("max"),
        F.bool_or(F.col("kind") == "allowed").alias("allowed"),
    )
    allowed = []
    for r in found.collect():
        if r["min"] is not None or r["max"] is not None:
            ranges[r["column"]] = {"min": r["min"], "max": r["max"]}
        if r["allowed"]:
            allowed.append(r["column"])
    return ranges, sorted(allowed, key=df.columns.index)


def _allowed_values(df: DataFrame, rules: DataFrame, column: str) -> DataFrame:
    """The allowed values of a column in its own type, once each."""
    kind = require(df, column).dtype
    listed = rules.filter((F.col("column") == column) & (F.col("kind") == "allowed")).select(F.explode("args").alias("v"))
    return listed.select(F.expr(f"try_cast(v AS {kind}) AS __allowed")).filter("__allowed IS NOT NULL").distinct()


def _bad_values(df: DataFrame, rules: DataFrame, column: str) -> DataFrame:
    """``__value, cnt``: present values that are not allowed; the table is counted by value before it meets the set."""
    value = clean(require(df, column))
    counts = df.selectExpr(f"{value} AS __value").filter("__value IS NOT NULL").groupBy("__value").agg(F.expr("count(1) AS cnt"))
    return counts.join(_allowed_values(df, rules, column), F.col("__value") == F.col("__allowed"), "left_anti")


def rule_table_report(df: DataFrame, rules: DataFrame) -> DataFrame:
    """:func:`constraint_report` for a rules table of any size, which never reaches the driver.

    ``rules`` has ``column``, ``kind`` (min, max, allowed) and ``args``, an array of
    strings. All min and max rules of a column hold, and a value is allowed if any
    of its allowed rules names it. Rules for absent columns are skipped; arguments
    that are not of the column's type allow nothing.
    """
    ranges, sets = _rule_columns(df, rules)
    out = constraint_report(df, ranges)
    for column in sets:
        value = clean(require(df, column))
        bad = _bad_values(df, rules, column).agg(F.coalesce(F.sum("cnt"), F.lit(0).cast("long")).alias("violations"))
        found = df.agg(F.expr(f"count({value}) AS checked_count")).crossJoin(bad)  # a row each
        out = out.unionByName(
            found.select(
                F.lit(column).alias("column"), F.lit("allowed").alias("constraint"), "checked_count", "violations",
                F.expr(percentage("violations", "checked_count")).alias("violation_percentage"),
            )
        )
    return out


def rule_table_rows(df: DataFrame, rules: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` breaks a rule of a rules table of any size.

    Values that are not allowed are found first, from counts; the frequent ones
    among them, at most a thousand, are broadcast, and the rest joined by value
    behind Spark's runtime filters, so a hot value is never one task.
    """
    ranges, sets = _rule_columns(df, rules)
    value = F.expr(clean(require(df, column)))
    out_of_range = F.lit(False)
    if column in ranges:
        ((_, _, _, out_of_range),) = _checks(df, {column: ranges[column]})
    out_of_range = F.coalesce(out_of_range, F.lit(False))
    if column not in sets:
        return df.filter(out_of_range)
    bad = _bad_values(df, rules, column)
    frequent = F.col("cnt") >= max(1000, df.count() / 1000)
    hot = bad.filter(frequent).select(F.col("__value").alias("__hot"))
    marked = df.join(F.broadcast(hot), value == F.col("__hot"), "left").withColumn("__out", out_of_range)
    settled = marked.filter("__out OR __hot IS NOT NULL").select(df.columns)
    rest = marked.filter("NOT __out AND __hot IS NULL").select(df.columns)
    return settled.unionByName(rest.join(bad.filter(~frequent), value == F.col("__value"), "left_semi"))
