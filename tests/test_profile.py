"""Known values of the profile and its edge cases."""

import datetime as dt
import math
from decimal import Decimal

import pytest

from plumbline import analyze
from plumbline.functions.text import LONG_BYTES
from plumbline.operators import profile as P


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize(
    "counts, bits",
    [
        ({"A": 50, "B": 30, "C": 20}, 1.4854752972273344),
        ({"A": 33, "B": 33, "C": 34}, 1.58481870497303),
        ({"Yes": 500, "No": 500}, 1.0),
    ],
)
def test_entropy(column, counts, bits):
    df = column([v for v, n in counts.items() for _ in range(n)], "string")
    row = by_column(P.profile(df))["x"]
    assert row["entropy"] == pytest.approx(bits, abs=1e-12)
    assert row["entropy"] <= math.log2(row["unique_count"]) + 1e-12


def test_quartiles_and_fences(column):
    values = [10.0, 12.0, 14.0, 15.0, 16.0, 18.0, 20.0, 22.0, 100.0, 200.0]
    row = by_column(P.profile(column(values)))["x"]
    assert (row["q1"], row["q3"]) == (14.25, 21.5)
    issue = analyze(column(values)).issues.filter("issue_type = 'outliers'").collect()[0]
    assert issue["details"]["lower_bound"] == 3.375
    assert issue["details"]["upper_bound"] == 32.375
    assert sorted(issue["details"]["examples"]) == ["100.0", "200.0"]


def test_nan_and_null_are_both_missing(column):
    row = by_column(P.profile(column([1.0, float("nan"), None, 2.0])))["x"]
    assert (row["missing_count"], row["unique_count"], row["mean"]) == (2, 2, 1.5)


def test_mixed_table(spark):
    rows = [
        (i, i / 10, "abc"[i % 3], dt.datetime(2020, 1, 1) + dt.timedelta(days=i), None if i % 10 == 0 else 1.0)
        for i in range(100)
    ]
    df = spark.createDataFrame(
        rows, "id long, num double, cat string, `a.date` timestamp, miss double"
    )
    found = by_column(P.profile(df, as_of="2020-02-01 00:00:00"))
    assert found["id"]["unique_count"] == 100
    assert found["cat"]["most_common"] == "a" and found["cat"]["most_common_count"] == 34
    assert found["miss"]["missing_percentage"] == 10.0
    assert found["a.date"]["date_range_days"] == 99 and found["a.date"]["future_dates"] == 68
    types = {r["category"]: r["columns"] for r in P.type_counts(df).collect()}
    assert types == {"numeric": 3, "categorical": 1, "datetime": 1}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string, c timestamp_ntz, d array<int>")
    found = by_column(P.profile(df))
    assert set(found) == set("abcd")
    assert all(r["total_count"] == 0 and r["missing_percentage"] == 0.0 for r in found.values())
    assert analyze(df).issues.count() == 0


def test_all_missing_and_one_row(spark):
    df = spark.createDataFrame([(None, None, True, 5)], "a double, b string, c boolean, d int")
    found = by_column(P.profile(df))
    assert found["a"]["missing_count"] == 1 and found["a"]["mean"] is None
    assert found["b"]["unique_count"] == 0 and found["b"]["most_common"] is None
    assert found["c"]["mean"] == 1.0 and found["c"]["q1"] is None
    assert found["d"]["std"] is None and found["d"]["skew"] is None
    assert analyze(df).issues.filter("column IN ('a', 'b')").count() == 0


def test_constant_column_has_no_skew(column):
    row = by_column(P.profile(column([3.0] * 20)))["x"]
    assert (row["skew"], row["kurtosis"], row["std"]) == (0.0, 0.0, 0.0)


def test_wide_integers_keep_their_identity(column):
    row = by_column(P.profile(column([2**60, 2**60 + 1, 2**60 + 2], "long")))["x"]
    assert row["unique_count"] == 3


def test_other_types(spark):
    df = spark.createDataFrame(
        [(Decimal("1.10"), dt.date(2020, 1, 1), [1], bytearray(b"x")), (Decimal("2.20"), None, None, None)],
        "dec decimal(10,2), day date, arr array<int>, bin binary",
    )
    found = by_column(P.profile(df))
    assert found["dec"]["mean"] == pytest.approx(1.65) and found["dec"]["unique_count"] == 2
    assert found["day"]["missing_count"] == 1
    assert found["arr"]["unique_count"] is None and found["arr"]["missing_count"] == 1
    assert P.dataset_shape(df).collect()[0]["rows"] == 2


def test_long_modes_share_their_beginning(column):
    """The mode among long values that begin alike is the smallest whole value."""
    head = "é" * LONG_BYTES
    values = [head + "b"] * 3 + [head + "a"] * 3 + [head + "0"] * 2 + ["short"] * 3
    row = by_column(P.profile(column(values, "string")))["x"]
    assert row["most_common"] == "short"
    row = by_column(P.profile(column(values[:-1], "string")))["x"]
    assert row["most_common"] == head + "a" and row["most_common_count"] == 3
    assert row["unique_count"] == 4


def test_plain_value_like_a_digest(column):
    long = "z" * 300
    import hashlib

    fake = "sha256:" + hashlib.sha256(long.encode()).hexdigest()
    row = by_column(P.profile(column([long, fake], "string")))["x"]
    assert row["unique_count"] == 2


def test_summary_and_report(spark):
    df = spark.createDataFrame([(i, None if i < 40 else 1.0) for i in range(100)], "id long, v double")
    found = analyze(df, "table")
    row = found.summary().collect()[0]
    assert (row["rows"], row["columns"], row["critical"]) == (100, 2, 1)
    assert row["missing_columns"][0]["column"] == "v"
    assert row["issues_by_type"] == {"missing_values": 1}
    report = found.column_report("v").collect()[0]
    assert report["issues"][0]["severity"] == "critical"
    assert found.column_report("nope") is None


def test_more_columns_than_one_stack(spark):
    wide = spark.range(50).selectExpr(*[f"id * {i} AS c{i}" for i in range(95)])
    found = by_column(P.profile(wide))
    assert len(found) == 95 and found["c94"]["max"] == 49 * 94
