import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import structure
from plumbline.plans.products import block_sums, correlations


def test_parts_with_centres_of_their_own(spark):
    """Tasks far apart, missing at first, wholly missing in some tasks, constant, and far from zero."""
    rng = np.random.default_rng(4)
    n, wide = 4000, 70
    x = rng.normal(size=(n, wide)) + 0.6 * rng.normal(size=(n, 1))
    x[:, 1] += 1e9
    x[:, 2] += np.arange(n) // 1000 * 1e4
    x[rng.random((n, wide)) < 0.1] = np.nan
    x[:1500, 3] = x[2500:, 4] = x[:, 5] = np.nan
    x[:, 6] = 7.0
    names = [f"w{i}" for i in range(wide)]
    rows = [(k, *(None if np.isnan(v) else float(v) for v in r)) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(["k long", *(f"{c} double" for c in names)])).repartitionByRange(8, "k")
    found = {(r["a"], r["b"]): r["r"] for r in correlations(block_sums(df.drop("k"), names), wide).collect()}
    want = pd.DataFrame(x).corr(min_periods=2).to_numpy()
    assert set(found) == {(a, b) for a in range(wide) for b in range(a + 1, wide)}
    for (a, b), r in found.items():
        assert (r is None) == bool(np.isnan(want[a, b])) and (r is None or abs(r - want[a, b]) < 1e-6)


def test_columns_are_read_once_by_short_methods(spark):
    """No job before the products, and the expressions of the columns stand outside whole-stage code."""
    df = spark.range(100).select(*[F.expr(f"CASE WHEN id % {i + 5} != 0 THEN id * {i} / 3 END").alias(f"w{i}") for i in range(30)])
    spark.sparkContext.setJobGroup("once", "once")
    pairs = structure.correlation_pairs(df)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("once")
    text = pairs._jdf.queryExecution().executedPlan().toString()
    projects = [line for line in text.splitlines() if "Project" in line and "CASE" in line]
    assert projects and all("lambda" in line for line in projects)
