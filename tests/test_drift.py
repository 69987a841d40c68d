"""PSI, KS and the drift table: known values, properties and edge cases."""

import math

import numpy as np
import pytest

from plumbline import analyze
from plumbline.operators import drift
from plumbline.plans import ecdf, orderstats


def psi(ref, cur):
    return drift.population_stability(ref, cur).collect()[0]["psi"]


def numpy_psi(ref, cur):
    edges = np.unique(np.percentile(ref, np.linspace(0, 100, 11)))
    r = np.histogram(ref, edges)[0] / len(ref)
    c = np.histogram(cur, edges)[0] / len(cur)
    r, c = np.where(r == 0, 1e-4, r), np.where(c == 0, 1e-4, c)
    return float(np.sum((c - r) * np.log(c / r)))


def numpy_ks(ref, cur):
    both = np.concatenate([ref, cur])
    a = np.searchsorted(np.sort(ref), both, side="right") / len(ref)
    b = np.searchsorted(np.sort(cur), both, side="right") / len(cur)
    return float(np.max(np.abs(a - b)))


PAIRS = {
    "stable": lambda g: (g.normal(680, 50, 1000), g.normal(682, 51, 500)),
    "shifted": lambda g: (g.normal(0, 1, 1000), g.normal(1.5, 1, 1000)),
    "heavy": lambda g: (g.pareto(2.0, 1000) * 100, g.pareto(1.8, 1000) * 100),
    "discrete": lambda g: (g.integers(0, 4, 1000) * 1.0, g.integers(1, 6, 700) * 1.0),
    "hot": lambda g: (
        np.where(g.random(900) < 0.4, 5.0, g.normal(5, 2, 900)),
        np.where(g.random(900) < 0.2, 5.0, g.normal(6, 2, 900)),
    ),
}


@pytest.mark.parametrize("kind", PAIRS)
@pytest.mark.parametrize("buckets", (0, 2, 300))
def test_numeric_against_numpy(column, monkeypatch, kind, buckets):
    """By value at once (0), and pruned by coarse to narrow buckets."""
    if buckets:
        monkeypatch.setattr(orderstats, "SKETCH_K", 40)
        monkeypatch.setattr(ecdf, "BUCKETS", buckets)
    left, right = PAIRS[kind](np.random.default_rng(42))
    ref, cur = column(list(map(float, left))), column(list(map(float, right)))
    assert psi(ref, cur) == pytest.approx(numpy_psi(left, right), rel=1e-9)
    row = drift.kolmogorov_smirnov(ref, cur).collect()[0]
    d = numpy_ks(left, right)
    n1, n2 = len(left), len(right)
    assert row["ks_statistic"] == pytest.approx(d, abs=1e-12)
    assert row["ks_p_value"] == pytest.approx(min(1, 2 * math.exp(-2 * d * d * n1 * n2 / (n1 + n2))))


def test_table_uses_brackets_and_buckets(column, monkeypatch):
    monkeypatch.setattr(orderstats, "SKETCH_K", 30)
    monkeypatch.setattr(ecdf, "PARTS", 2)
    left, right = PAIRS["heavy"](np.random.default_rng(3))
    row = drift.drift_table(column(list(map(float, left))), column(list(map(float, right)))).collect()[0]
    assert row["psi"] == pytest.approx(numpy_psi(left, right), rel=1e-9)
    assert row["ks_statistic"] == pytest.approx(numpy_ks(left, right), abs=1e-12)
    assert row["pct_change"] == pytest.approx((right.mean() - left.mean()) / left.mean() * 100)


def test_same_table_does_not_drift(column):
    df = column([float(i % 37) for i in range(500)])
    row = drift.drift_table(df, df).collect()[0]
    assert (row["psi"], row["ks_statistic"], row["drift_status"], row["pct_change"]) == (0.0, 0.0, "stable", 0.0)


def test_five_buckets(column):
    ref = [k for k, n in zip("abcde", (10, 20, 40, 20, 10)) for _ in range(n)]
    cur = [k for k, n in zip("abcde", (5, 10, 35, 30, 20)) for _ in range(n)]
    want = sum(
        (c - r) * math.log(c / r) for r, c in zip((0.1, 0.2, 0.4, 0.2, 0.1), (0.05, 0.1, 0.35, 0.3, 0.2))
    )
    found = drift.population_stability(column(ref, "string"), column(cur, "string")).collect()[0]
    assert found["psi"] == pytest.approx(want) and found["drift_status"] == "moderate"


def test_category_seen_on_one_side_only(column):
    found = psi(column(["a", "b"], "string"), column(["b", "c"], "string"))
    assert found == pytest.approx(2 * (0.5 - 1e-4) * math.log(0.5 / 1e-4))


def test_ks_of_a_spike_and_of_disjoint_sides(column, monkeypatch):
    monkeypatch.setattr(ecdf, "BUCKETS", 8)
    rng = np.random.default_rng(5)
    wide = rng.normal(0, 100, 800)
    for other in (rng.normal(0, 0.01, 500), wide + 10_000, np.full(50, 3.0), -wide):
        row = drift.kolmogorov_smirnov(
            column(list(map(float, wide))), column(list(map(float, other)))
        ).collect()[0]
        assert row["ks_statistic"] == pytest.approx(numpy_ks(wide, other), abs=1e-12)


def test_ks_by_hand(column):
    ref = column([10.0, 20.0, 30.0, 40.0, 50.0])
    cur = column([15.0, 25.0, 35.0, 45.0, 55.0])
    row = drift.kolmogorov_smirnov(ref, cur).collect()[0]
    assert row["ks_statistic"] == pytest.approx(0.2) and row["ks_p_value"] == 1.0


def test_constant_and_binary_columns_have_no_psi(column):
    assert psi(column([5.0] * 20), column([5.0] * 30)) == 0.0
    # deciles 0 and 1 only, one bin: nothing can move (a median of 0.5 would make two)
    ref, cur = [0, 1] * 10 + [1], [0, 0, 0, 1]
    assert psi(column(ref, "long"), column(cur, "long")) == numpy_psi(ref, cur) == 0.0
    ref = [0, 1] * 10
    assert psi(column(ref, "long"), column(cur, "long")) == pytest.approx(numpy_psi(ref, cur))


def test_values_outside_the_reference_stay_in_the_total(column):
    ref, cur = [float(i) for i in range(100)], [float(i) for i in range(50, 150)]
    assert psi(column(ref), column(cur)) == pytest.approx(numpy_psi(np.array(ref), np.array(cur)))


def test_boolean_columns(column):
    found = psi(column([True] * 30 + [False] * 70, "boolean"), column([True] * 60 + [False] * 40, "boolean"))
    assert found == pytest.approx(0.3 * math.log(0.6 / 0.3) + (-0.3) * math.log(0.4 / 0.7))


def test_empty_sides_and_other_columns(spark):
    ref = spark.createDataFrame([(1.0, "a", None, 1)], "v double, s string, e double, only_ref int")
    cur = spark.createDataFrame([(None, None, 2.0, 1)], "v double, s string, e double, only_cur int")
    rows = {r["column"]: r for r in drift.drift_table(ref, cur).collect()}
    assert list(rows) == ["e", "s", "v"]
    assert all(r["psi"] == 0.0 and r["drift_status"] == "stable" for r in rows.values())
    assert rows["v"]["ks_statistic"] == 0.0 and rows["v"]["ks_p_value"] == 1.0
    assert rows["s"]["ks_statistic"] is None and rows["v"]["pct_change"] is None


def test_mean_changes(spark):
    ref = spark.createDataFrame([(0.0, -2.0), (0.0, -2.0)], "zero double, neg double")
    cur = spark.createDataFrame([(5.0, -1.0), (5.0, -1.0)], "zero double, neg double")
    rows = {r["column"]: r["pct_change"] for r in drift.mean_changes(ref, cur).collect()}
    assert rows == {"zero": 0.0, "neg": -50.0}
    same = drift.compare_profiles(analyze(ref).profile, analyze(cur).profile)
    assert {r["column"]: r["pct_change"] for r in same.collect()} == rows


def test_mixed_types_are_compared_as_text(spark):
    ref = spark.createDataFrame([(1,), (2,)], "k int")
    cur = spark.createDataFrame([("1",), ("2",)], "k string")
    assert psi(ref, cur) == 0.0


@pytest.mark.parametrize("kind", ["uniform", "tails", "ties"])
def test_ks_looks_at_few_values(spark, monkeypatch, kind):
    """Without drift, buckets decide all but a few rows; no more than a tenth is looked at by value."""
    rng = np.random.default_rng(8)
    make = {
        "uniform": lambda: rng.random(40_000),
        "tails": lambda: np.exp(10 * rng.normal(size=40_000)) * rng.choice([-1, 1], 40_000),
        "ties": lambda: np.round(rng.normal(0, 3, 40_000)),
    }[kind]
    left, right = make(), make()
    frames = [spark.createDataFrame([(float(x),) for x in v], "x double") for v in (left, right)]
    seen, count = [], ecdf._paired_counts
    monkeypatch.setattr(ecdf, "_paired_counts", lambda long, *w: seen.append(long) or count(long, *w))
    found = ecdf.ks_distances(*frames, [(0, "x", "x")], {0: (40_000, 40_000)}).collect()[0]["d"]
    assert found == pytest.approx(numpy_ks(left, right), abs=1e-12)
    assert sum(rows.count() for rows in seen) < 8_000


def test_ks_refines_a_cluster_until_parts_are_small(spark, monkeypatch):
    """A third of the rows lies within a billionth of the range; no task ranks more than a few of them."""
    monkeypatch.setattr(ecdf, "IN_TASK", 150)
    rng = np.random.default_rng(9)
    make = lambda: np.concatenate([rng.uniform(-1, 1, 4000), 0.3 + 1e-9 * rng.uniform(0, 1, 2000), 0.3 + 1e-13 * rng.normal(size=300)])
    left, right = make(), make()
    frames = [spark.createDataFrame([(float(x),) for x in v], "x double") for v in (left, right)]
    seen, count = [], ecdf._paired_counts
    monkeypatch.setattr(ecdf, "_paired_counts", lambda long, *w: seen.append(long) or count(long, *w))
    found = ecdf.ks_distances(*frames, [(0, "x", "x")], {0: (6300, 6300)}).collect()[0]["d"]
    assert found == pytest.approx(numpy_ks(left, right), abs=1e-12)
    assert all(r["count"] <= 150 for rows in seen for r in rows.groupBy("key", "path").count().collect())


def test_ks_with_infinities_and_extremes(column):
    inf, big = float("inf"), 1.7e308
    left, right = [-inf, -big, 0.0, 5e-324, 1.0, big, inf, inf], [-inf, -inf, -1.0, 0.0, 2.0, big, inf]
    row = drift.kolmogorov_smirnov(column(left), column(right)).collect()[0]
    assert row["ks_statistic"] == pytest.approx(numpy_ks(np.array(left), np.array(right)), abs=1e-12)
