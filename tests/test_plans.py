"""The shape of the plans: what must hold whatever the size of the input."""

import pytest

from plumbline.operators import charts, drift, profile, rows, structure
from plumbline.plans import orderstats

SF = "/root/testdata/sf0.01"


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def line(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def test_no_python_and_no_cross_join(spark, line):
    early, late = line.filter("l_quantity < 25"), line.filter("l_quantity >= 25")
    for df in (
        profile.missing_counts(line),
        structure.correlation_pairs(line),
        charts.histogram(line),
        charts.top_categories(line),
        drift.population_stability(early, late),
        drift.kolmogorov_smirnov(early, late),
        drift.drift_table(early, late),
    ):
        text = plan(df)
        for bad in ("ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in text


def test_outlier_filter_reaches_the_scan(line):
    text = plan(rows.problem_rows(line, "l_extendedprice", "outliers").select("l_orderkey"))
    assert "PushedFilters: [Or(LessThan(l_extendedprice," in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in text


def test_missing_filter_reaches_the_scan(line):
    assert "IsNull(l_returnflag)" in plan(rows.problem_rows(line, "l_returnflag", "missing_values"))


def test_column_subsets_prune_the_scan(line):
    text = plan(structure.correlation_pairs(line, ["l_quantity", "l_tax"]))
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text


def test_rows_combine_before_the_shuffle(line, monkeypatch):
    """Outside the brackets a column reaches the shuffle as a handful of rows."""
    frame, entries = orderstats.proposed_statistics(line, [(0, "l_extendedprice")], (0.5,))
    cells = orderstats._cells(line, entries, False)
    assert cells.count() < 60_000 * 0.02
    assert frame.filter("missed").count() == 0


def test_windows_run_in_generated_groups(line):
    text = plan(charts.top_categories(line), "simple")
    assert "WindowGroupLimit" in text
