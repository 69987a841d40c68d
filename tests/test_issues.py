"""Issue rules, severities and problem rows."""

import pytest

from plumbline import Config, analyze, split_rules, validate_thresholds
from plumbline.operators import constraints, report, rows
from plumbline.operators.issues import issues_by_severity


def kinds(found):
    return {(r["column"], r["issue_type"], r["severity"]) for r in found.issues.collect()}


def test_missing_levels(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "col1 double")
    assert ("col1", "missing_values", "critical") in kinds(analyze(df))
    assert ("col1", "missing_values", "warning") in kinds(analyze(df, config={"missing_critical": 0.6}))


def test_missing_thresholds_are_strict(column):
    df = column([None] * 3 + [1.0, 2.0, 1.0, 2.0, 1.0, 2.0, 1.0])
    issue = analyze(df).issues.filter("issue_type = 'missing_values'").collect()[0]
    assert issue["severity"] == "warning" and issue["details"]["threshold"] == 5.0
    assert issue["message"] == "Moderate percentage of missing values (30.0%)"


def test_outliers_of_ages(spark):
    ages = [25, 26, 25, 24, 25, 150, -5, 25, 26, 25]
    emails = ["a"] * 8 + [None] * 2
    df = spark.createDataFrame(list(zip(ages, emails)), "age long, email string")
    found = analyze(df)
    assert ("age", "outliers", "critical") in kinds(found)
    assert ("email", "missing_values", "warning") in kinds(found)
    details = found.issues.filter("issue_type = 'outliers'").collect()[0]
    assert details["affected_percentage"] == 20.0
    assert (details["details"]["lower_bound"], details["details"]["upper_bound"]) == (23.875, 26.875)
    assert details["details"]["examples"] == ["150.0", "-5.0"]


def test_ten_values_for_an_issue_but_not_for_rows(column):
    df = column([1.0, 2.0, 3.0, 4.0, 5.0, 1000.0, 7.0, 8.0, float("nan"), 10.0])
    found = analyze(df)
    assert not [k for k in kinds(found) if k[1] == "outliers"]
    assert found.problem_rows("x", "outliers").count() == 1
    assert found.problem_rows("x", "missing_values").count() == 1
    assert found.problem_rows("x").count() == 2
    with pytest.raises(ValueError):
        found.problem_rows("y")


def test_spelling_groups(column):
    values = ["Apple"] * 40 + ["apple"] * 5 + ["Orange"] * 40 + ["orange "] * 5 + ["Banana"] * 10
    issue = analyze(column(values, "string")).issues.filter("issue_type = 'inconsistent_values'").collect()[0]
    assert issue["affected_count"] == 90 and issue["affected_percentage"] == 90.0
    assert issue["details"]["unique_normalized_values"] == 3
    assert issue["details"]["examples"] == ["Apple | apple", "Orange | orange "]


def test_spelling_of_departments(column):
    values = ["Engineering"] * 3 + ["engineering"] + ["Marketing"] * 2 + ["marketing"] + ["HR", "Sales", None]
    issue = analyze(column(values, "string")).issues.filter("issue_type = 'inconsistent_values'").collect()[0]
    assert issue["affected_count"] == 7


def test_spelling_by_unicode_space_and_length(column):
    long = "word " * 60
    values = ["a", "a\xa0", " A\x1f", "b", long, long.strip().upper(), "c" + " " * 200, "C"]
    issue = analyze(column(values, "string")).issues.filter("issue_type = 'inconsistent_values'").collect()[0]
    assert issue["affected_count"] == 7
    assert issue["details"]["unique_normalized_values"] == 4


def test_excluded_values(column):
    df = column([float(v) for v in range(1, 21)] + [999.0] * 3)
    config = {"exclude_values": {"x": [999]}}
    assert not [k for k in kinds(analyze(df, config=config)) if k[1] == "outliers"]
    assert [k for k in kinds(analyze(df)) if k[1] == "outliers"]
    assert rows.problem_rows(df, "x", "outliers", config).count() == 0
    assert analyze(df, config=config).profile.collect()[0]["max"] == 999.0
    words = column(["n/a", "N/A", "x", "X"], "string")
    issue = analyze(words, config={"exclude_values": {"x": ["N/A"]}}).issues
    assert issue.filter("issue_type = 'inconsistent_values'").collect()[0]["affected_count"] == 2


def test_future_dates_and_low_cardinality(spark):
    df = spark.sql("SELECT timestamp_ntz'2030-01-01 00:00:00' AS t, 'k' AS k FROM range(200)")
    found = kinds(analyze(df, as_of="2024-01-01 00:00:00"))
    assert found == {("t", "future_dates", "warning"), ("k", "low_cardinality", "info")}


def test_missing_dates_raise_no_issue_unless_asked(spark):
    df = spark.sql("SELECT cast(NULL AS timestamp_ntz) AS t FROM range(10)")
    assert kinds(analyze(df)) == set()
    assert kinds(analyze(df, config={"missing_all_types": True})) == {("t", "missing_values", "critical")}


def test_booleans_have_no_outliers(spark):
    df = spark.sql("SELECT id = 0 AS b FROM range(50)")
    assert kinds(analyze(df)) == {("b", "skewed_distribution", "info")}


def test_severity_counts_include_zero(column):
    counts = {r["severity"]: r["issues"] for r in issues_by_severity(analyze(column([1.0])).issues).collect()}
    assert counts == {"critical": 0, "warning": 0, "info": 0}


def test_any_problem_rows(spark):
    data = [(i, float(i % 5), "x") for i in range(40)] + [(99, 500.0, None), (98, None, "x")]
    df = spark.createDataFrame(data, "id long, v double, s string")
    found = rows.any_problem_rows(df, ["v", "s"], tag="why").collect()
    assert {(r["id"], tuple(r["why"])) for r in found} == {(99, ("v", "s")), (98, ("v",))}


def test_thresholds():
    assert validate_thresholds({"missing_critical": 0.4, "other": 1})["missing_critical"] == 0.4
    with pytest.warns(UserWarning):
        assert validate_thresholds({"missing_critical": 1.5})["missing_critical"] == 0.3
    assert validate_thresholds({"outlier_threshold": 3})["outlier_threshold"] == 3
    assert Config.of({"skew_threshold": 2, "unknown": 1}).skew_threshold == 2


def test_constraints(spark):
    data = [(i, 20 + i, "ABC"[i % 3]) for i in range(48)] + [(48, 150, "Z"), (49, -5, None)]
    df = spark.createDataFrame(data, "id long, age long, kind string")
    config, rules = split_rules(
        {
            "thresholds": {"outlier_threshold": 2.0},
            "column_rules": {"age": {"min": 0, "max": 120}, "kind": {"allowed": ["A", "B", "C"]}},
        }
    )
    assert config.outlier_threshold == 2.0
    found = {r["column"]: r for r in constraints.constraint_report(df, rules).collect()}
    assert found["age"]["violations"] == 2 and found["age"]["violation_percentage"] == 4.0
    assert found["kind"]["violations"] == 1 and found["kind"]["checked_count"] == 49
    assert {r["id"] for r in constraints.constraint_rows(df, rules).collect()} == {48, 49}
    table = spark.createDataFrame(
        [("age", "min", ["0"]), ("age", "max", ["120"]), ("kind", "allowed", ["A", "B", "C"])],
        "column string, kind string, args array<string>",
    )
    assert constraints.rules_from_table(table) == {
        "age": {"min": 0.0, "max": 120.0},
        "kind": {"allowed": ["A", "B", "C"]},
    }


def test_report_tables(spark):
    df = spark.createDataFrame([(None if i % 2 else float(i),) for i in range(100)], "v double")
    found = analyze(df)
    rules = [r["rule"] for r in report.recommendations(found.profile, found.issues).collect()]
    assert rules == ["critical", "much_missing"]
    assert report.quality_grade(found.issues).collect()[0]["grade"] == "POOR"
    score = report.health_score(found.issues).collect()[0]
    assert (score["health_score"], score["approved"]) == (90, True)
    good = analyze(spark.range(5).toDF("id"))
    assert [r["rule"] for r in report.recommendations(good.profile, good.issues).collect()] == ["good"]
