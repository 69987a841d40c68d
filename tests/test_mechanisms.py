"""States, sketches, duplicates, spellings, rule tables, wide correlations, stream windows and samples."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import analyze
from plumbline.operators import charts, constraints, duplicates, sampling, spelling, states, structure
from plumbline.plans import heavy
from plumbline.streaming import windows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# States ------------------------------------------------------------------


def test_merged_states_are_those_of_all_rows(spark):
    rng = np.random.default_rng(4)
    parts = [rng.normal(1e6 * k, 1 + k, 300) for k in range(4)] + [np.full(50, 7.0), np.array([np.nan, 3.0])]
    cells = [(i, float(x), int(2**53 + 1 + j)) for i, p in enumerate(parts) for j, x in enumerate(p)] + [(9, None, None)]
    df = spark.createDataFrame(cells, "part int, x double, big long").repartition(3)
    found = {r["column"]: r for r in states.profile_from_states(states.profile_states(df, ["part"])).collect()}
    x = pd.Series([c[1] for c in cells], dtype=float).dropna()
    got = found["x"]
    for name, want in (("mean", x.mean()), ("std", x.std()), ("skew", x.skew()), ("kurtosis", x.kurt()), ("min", x.min()), ("max", x.max())):
        assert got[name] == pytest.approx(want, rel=1e-9), name
    assert (got["total_count"], got["missing_count"]) == (len(cells), 2)
    assert (found["big"]["min_whole"], found["big"]["max_whole"]) == (2**53 + 1, 2**53 + 300)
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert (x < got[name]).mean() <= p + 0.01 and (x <= got[name]).mean() >= p - 0.01


def test_states_merge_in_any_order(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").withColumn("day", F.to_date("ts")).withColumn("month", F.month("ts"))
    by_day = states.profile_states(df, ["day", "month"])
    twice = states.merge_states(states.merge_states(by_day, ["month"]))
    once = states.merge_states(by_day)
    keep = ["column", "total", "n", "zeros", "lo", "hi", "lo_date", "hi_date"]
    assert rows(twice.select(keep)) == rows(once.select(keep))
    for a, b in zip(rows(twice.select("column", "mean", "m2", "m3", "m4")), rows(once.select("column", "mean", "m2", "m3", "m4")), strict=True):
        assert a[0] == b[0] and all(x == y or x == pytest.approx(y, rel=1e-9) for x, y in zip(a[1:], b[1:]))


def test_states_of_odd_columns(spark):
    df = spark.createDataFrame([(None, [1], "a", True), (None, [1], "a", None)], "nothing double, list array<int>, t string, b boolean")
    found = {r["column"]: r for r in states.profile_from_states(states.profile_states(df)).collect()}
    assert found["nothing"]["unique_count"] == 0 and found["nothing"]["median"] is None and found["nothing"]["mean"] is None
    assert found["list"]["unique_count"] is None and found["t"]["most_common"] == "a" and found["t"]["most_common_count"] == 2
    assert found["b"]["missing_count"] == 1 and found["b"]["mean"] == 1.0
    assert states.profile_from_states(states.profile_states(df.limit(0))).count() == 0


def test_approximate_distinct_counts_shuffle_no_value(spark):
    df = spark.range(200_000).selectExpr("id AS big", "concat('t', id % 50000) AS text", "cast(id % 7 AS double) AS few")
    found = {r["column"]: r for r in analyze(df, approx_distinct=True).profile.collect()}
    for name, want in (("big", 200_000), ("text", 50_000), ("few", 7)):
        assert abs(found[name]["unique_count"] - want) <= 0.02 * want
    assert found["text"]["most_common"] is None and found["text"]["entropy"] is None


def test_exact_range_of_large_integers(spark):
    df = spark.createDataFrame([(2**53 + 1,), (2**53 + 3,), (None,)], "x long")
    r = analyze(df).profile.first()
    assert (r["min_exact"], r["max_exact"]) == (str(2**53 + 1), str(2**53 + 3))


# Frequent values ---------------------------------------------------------


def test_top_values_by_either_way(spark, monkeypatch):
    pick = random.Random(1)
    cells = [("a" if pick.random() < 0.3 else f"v{pick.randrange(300)}", f"long {'x' * 150} {pick.randrange(40)}", None) for _ in range(4000)]
    df = spark.createDataFrame(cells, "s string, l string, n string").repartition(4)
    infos = [c for c in structure.describe_columns(df)]
    want = []
    for key in (0, 1):
        counts = pd.Series([c[key] for c in cells]).value_counts()
        best = sorted(counts.items(), key=lambda p: (-p[1], p[0]))[:5]
        want += [(key, v, n, len(cells), i) for i, (v, n) in enumerate(best, 1)]
    get = lambda: rows(heavy.top_values(df, infos, 5).select("key", "value", "cnt", "n", "place"))
    assert get() == sorted(want, key=str)
    monkeypatch.setattr(heavy, "TRACKED", 16)
    monkeypatch.setattr(heavy, "ERROR", 3.5 / 16)
    assert get() == sorted(want, key=str)


def test_texts_that_hardly_repeat(spark):
    """Whole texts of one beginning: the winners are told apart behind it."""
    texts = ["same beginning " * 20 + str(i) for i in range(60)] + ["same beginning " * 20 + "7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    out = {r["category"]: r["cnt"] for r in charts.top_categories(df, limit=4).collect()}
    assert out == {"same beginning " * 20 + "7": 2, "same beginning " * 20 + "0": 1, "same beginning " * 20 + "1": 1, "Other": 57}


# Duplicates --------------------------------------------------------------


def test_duplicates_of_whole_rows(spark):
    cells = [(1, "a", None, 0.0), (1, "a", None, -0.0), (1, "a", "", 0.0), (1, "a", "N", 0.0), (12, "3", None, 0.0), (1, "23", None, 0.0),
             (None, None, None, None), (None, None, None, None), (2, "b", "c", float("nan")), (2, "b", "c", float("nan"))]
    df = spark.createDataFrame(cells, "i int, s string, t string, d double").repartition(3)
    assert rows(duplicates.duplicate_summary(df)) == [(10, 7, 3, 3, 2)]
    assert duplicates.duplicate_members(df).count() == 6
    assert sorted(r["copies"] for r in duplicates.duplicate_groups(df).collect()) == [2, 2, 2]
    assert rows(duplicates.duplicate_summary(df.limit(0))) == [(0, 0, 0, 0, 0)]
    assert duplicates.duplicate_members(df.limit(0)).columns == [*df.columns, "copies"]


def test_a_third_of_the_rows_are_one(spark):
    df = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('r', id % 5000) END AS s", "array(1, NULL) AS a")
    got = duplicates.duplicate_members(df)
    want = df.groupBy("s").count().filter("count > 1")
    assert rows(got.groupBy("s", "copies").count()) == rows(want.selectExpr("s", "count AS copies", "count"))


# Spelling ----------------------------------------------------------------


@pytest.mark.parametrize("limit", [200_000, 0])
def test_canonical_spelling(spark, limit, monkeypatch):
    monkeypatch.setattr(spelling, "FREQUENT_SHARE", 1 / 10)
    words = ["Apple"] * 1500 + ["apple"] * 40 + [" APPLE\t"] * 1100 + ["b"] * 3 + ["B"] * 3 + ["solo"] + [None] * 5 + ["L" * 200] * 2 + ["l" * 200]
    df = spark.createDataFrame([(i, w, w) for i, w in enumerate(words)], "id int, w string, other string").repartition(5)
    fix = {"apple": "Apple", " APPLE\t": "Apple", "b": "B", "l" * 200: "L" * 200}
    want = sorted(((i, fix.get(w, w), w) for i, w in enumerate(words)), key=str)
    assert rows(spelling.canonical_spelling(df, ["w"], limit)) == want
    assert spelling.canonical_spelling(df.limit(0), ["w"], limit).count() == 0


# Rule tables -------------------------------------------------------------


def test_a_hundred_thousand_rules(spark):
    rules = spark.range(100_000).selectExpr("'k' AS column", "'allowed' AS kind", "array(cast(id * 2 AS string)) AS args")
    rules = rules.unionByName(spark.createDataFrame([("x", "min", ["0"]), ("x", "max", ["5"]), ("k", "max", ["150000"])], rules.schema))
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7L ELSE id * 11 END AS k", "CASE WHEN id % 10 = 0 THEN NULL ELSE cast(id % 9 AS double) END AS x")
    data = df.toPandas()
    allowed = set(range(0, 200_000, 2))
    bad = ~data.k.isin(allowed)
    report = {(r["column"], r["constraint"]): r["violations"] for r in constraints.rule_table_report(df, rules).collect()}
    assert report == {("k", "range"): (data.k > 150_000).sum(), ("k", "allowed"): bad.sum(), ("x", "range"): (data.x > 5).sum()}
    assert constraints.rule_table_rows(df, rules, "k").count() == (bad | (data.k > 150_000)).sum()
    assert constraints.rule_table_rows(df, rules, "x").count() == (data.x > 5).sum()


# Wide correlations -------------------------------------------------------


def test_three_hundred_columns(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1, (400, 3))
    data = pd.DataFrame(base @ rng.normal(0, 1, (3, 300)) + rng.normal(0, 1, (400, 300)) + 1e5, columns=[f"c{i}" for i in range(300)])
    data["c5"] = 3.0
    data.loc[::7, "c9"] = np.nan
    found = structure.correlation_pairs(spark.createDataFrame(data).repartition(4)).toPandas()
    assert len(found) == 300 * 299 // 2
    want = data.corr()
    got = found.set_index(["col1", "col2"]).r
    for a, b in [("c0", "c1"), ("c9", "c200"), ("c63", "c64"), ("c298", "c299"), ("c9", "c10")]:
        assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)
    assert np.isnan(got["c4", "c5"]) or got["c4", "c5"] is None


# Streams -----------------------------------------------------------------


def _arrive(spark, folder, chunks):
    start = datetime(2024, 1, 1)
    for chunk in chunks:
        cells = [(start + timedelta(minutes=m), v) for m, v in chunk]
        spark.createDataFrame(cells, "at timestamp_ntz, v double").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema("at timestamp_ntz, v double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_late_rows(spark, folder):
    """A row within the delay still counts; one whose window is closed is left out."""
    chunks = [[(5, 1.0), (50, 2.0)], [(150, 3.0), (59, 4.0)], [(600, 5.0)], [(601, 8.0)], [(10, 6.0), (590, None)], [(700, 7.0)]]
    stream = _arrive(spark, folder, chunks)
    out = windows.run_windows(windows.window_profile(stream, "at", width="1 hour", delay="2 hours"), f"{folder}/out")
    got = {r["window_start"].hour: (r["total_count"], r["missing_count"], r["mean"]) for r in out.collect()}
    assert got == {0: (3, 0, pytest.approx(7 / 3)), 2: (1, 0, 3.0), 9: (1, 1, None), 10: (2, 0, 6.5), 11: (1, 0, 7.0)}


def test_drift_by_window(spark, folder):
    ref = spark.createDataFrame([(float(i % 100),) for i in range(1000)], "v double")
    bins = windows.reference_bins(ref, ["v"])
    same = [(i, float(i % 100)) for i in range(60)] + [(0, float(i)) for i in range(60, 100)]
    stream = _arrive(spark, folder, [same, [(70 + i % 40, 95.0) for i in range(80)]])
    out = {r["window_start"].hour: r for r in windows.run_windows(windows.window_drift(stream, "at", bins, "1 hour"), f"{folder}/out").collect()}
    assert out[0]["drift_status"] == "stable" and out[0]["psi"] == pytest.approx(0, abs=1e-9)
    assert out[1]["drift_status"] == "significant" and out[1]["n"] == 80


# Samples -----------------------------------------------------------------


def test_samples_of_frames_that_multiply_rows(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    copies = orders.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(10))))
    names = spark.range(10).withColumnRenamed("id", "k")
    joined = orders.crossJoin(F.broadcast(names))
    for df in (copies, joined):
        found = sampling.sample_rows(df, 1000)
        keys = found.select("o_orderkey").distinct().count()
        n = orders.count()
        expected = n * (1 - (1 - 1000 / (10 * n)) ** 10)
        assert found.count() == 1000 and abs(keys - expected) < 60
        assert rows(found) == rows(sampling.sample_rows(df, 1000))


def test_large_samples_are_cut_by_counts(spark, monkeypatch):
    line = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    sorted_sample = rows(sampling.sample_rows(line, 700))
    monkeypatch.setattr(sampling, "IN_TASK", 10)
    monkeypatch.setattr(sampling, "CELLS", 16)
    assert rows(sampling.sample_rows(line, 700)) == sorted_sample
    assert rows(sampling.sample_rows(line.repartition(5), 700)) == sorted_sample
