"""Files: what is written is read back, markers of missing values, and input that cannot be read."""

import json

import pytest

from plumbline import analyze, load_table, write_table
from plumbline.operators import charts, drift
from plumbline.sources.tables import sample_large_file

TRICKY = [
    (1, 'He said ""hi, all""', "a\nb"), (2, '"', "  blanks  "), (3, "", None), (4, "a,b;c\t", "\r\nx"), (5, "\\", 'end"'),
    (6, None, "NA"),
]
SCHEMA = "k long, a string, b string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("ending", [".csv", ".json", ".jsonl", ".parquet", ".orc"])
def test_round_trip(spark, tmp_path, ending):
    df = spark.createDataFrame(TRICKY, SCHEMA).repartition(2)
    path = str(tmp_path / f"t{ending}")
    write_table(df, path)
    found = load_table(spark, path, schema=df.schema, missing=())
    assert sorted(map(str, rows(found))) == sorted(map(str, rows(df)))


def test_json_by_content(spark, tmp_path):
    records = [{"a": 1, "b": "x"}, {"a": 2, "b": None}, {"a": 3, "b": "[]"}]
    for name, text in (
        ("lines", "\n" + "\n".join(json.dumps(r) for r in records)),
        ("array", json.dumps(records)),
        ("pretty", json.dumps(records, indent=1)),
    ):
        path = tmp_path / f"{name}.json"
        path.write_text(text)
        assert load_table(spark, str(path)).count() == 3, name
    (tmp_path / "one.json").write_text(json.dumps(records[0], indent=2))
    assert rows(load_table(spark, str(tmp_path / "one.json"))) == [(1, "x")]


def test_markers_and_types(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('v,w,d,t,f,z,n\n1,1.5,2020-01-01,x,True,007,NA\n2,NA,2020-01-02,N/A,false,1,null\nNA,-2e3,,"null",,2,\n4,3,2020-02-30,"",True,3,#N/A\n')
    df = load_table(spark, str(path))
    assert dict(df.dtypes) == {
        "v": "bigint", "w": "double", "d": "string", "t": "string", "f": "boolean", "z": "bigint", "n": "double",
    }
    assert [r["v"] for r in df.collect()] == [1, 2, None, 4]
    assert [r["t"] for r in df.collect()] == ["x", None, None, None]
    found = {r["column"]: r for r in analyze(df).profile.collect()}
    assert found["v"]["missing_count"] == 1 and found["v"]["mean"] == pytest.approx(7 / 3) and found["n"]["missing_count"] == 4
    good = tmp_path / "d.csv"
    good.write_text("d,s\n2020-01-01,2020-01-01 10:00:00\n2020-01-02,2020-01-02 11:30:00\n")
    assert [t for _, t in load_table(spark, str(good)).dtypes] == ["string", "string"]
    assert [t for _, t in load_table(spark, str(good), dates=True).dtypes] == ["date", "timestamp"]


def test_unreadable_files_warn(spark, tmp_path):
    bad = tmp_path / "bad.parquet"
    bad.write_bytes(b"not a parquet file at all, but long enough to have a footer")
    with pytest.warns(UserWarning, match="cannot sample"):
        assert sample_large_file(spark, str(bad)).count() == 0
    with pytest.warns(UserWarning, match="cannot sample"):
        assert sample_large_file(spark, str(tmp_path / "absent.csv")).count() == 0


def test_mixed_exclusions(spark):
    df = spark.createDataFrame([(float(i % 7), "x" if i % 3 else "X ") for i in range(40)] + [(999.0, "N/A")], "b double, c string")
    config = {"exclude_values": {"b": ["N/A", None, 999, float("nan")], "c": [0, None, "N/A"]}}
    found = analyze(df, config=config)
    assert found.issues.filter("issue_type = 'outliers'").count() == 0
    assert found.problem_rows("b", "outliers").count() == 0
    assert analyze(df).problem_rows("b", "outliers").count() == 1


def test_tables_without_numbers_or_shared_columns(spark):
    text = spark.createDataFrame([("a",), ("b",)], "c string")
    gaps = spark.createDataFrame([(None,), (None,)], "x double")
    for frame in (charts.histogram(text), charts.distribution_stats(text), charts.box_stats(text), charts.box_stats(gaps)):
        assert frame.count() == 0 and "column" in frame.columns
    assert drift.mean_changes(text, text).count() == 0
    assert drift.drift_table(text, gaps).count() == 0
    assert drift.kolmogorov_smirnov(text, gaps).count() == 0 and drift.population_stability(text, gaps).count() == 0


def test_ranks_that_keep_missing_fail(spark, monkeypatch):
    from plumbline.plans import orderstats

    df = spark.range(4000).selectExpr("cast(id AS double) AS x")
    monkeypatch.setattr(orderstats, "BRACKET_ROWS", 1)
    monkeypatch.setattr(orderstats, "MAX_ROUNDS", 1)
    monkeypatch.setattr(orderstats, "SKETCH_K", 8)
    with pytest.raises(RuntimeError, match="differ between scans"):
        orderstats.order_statistics(df, [(0, "x")], (0.5,)).collect()


def test_samples_do_not_depend_on_the_split(spark, tmp_path):
    from plumbline import sample_rows

    frames = [spark.range(5000).selectExpr("id % 2500 AS id", "'x' AS c")]
    path = str(tmp_path / "s.parquet")
    frames[0].repartition(3).write.parquet(path)
    frames.append(spark.read.parquet(path))
    for df in frames:
        draw = lambda d: sorted(r["id"] for r in sample_rows(d, 500, seed=7).collect())
        assert draw(df) == draw(df.repartition(7)) and len(draw(df)) == 500
        assert sorted(r["id"] for r in sample_rows(df, 500, seed=8).collect()) != draw(df)
    hot = spark.createDataFrame([(1 if i % 3 else i,) for i in range(6000)], "id long").repartition(4)
    share = sample_rows(hot, 900).filter("id = 1").count() / 900
    assert abs(share - 2 / 3) < 0.08
    strata = sample_rows(frames[1].selectExpr("id", "id % 3 AS g"), 300, stratify_by="g")
    again = sample_rows(frames[1].repartition(5).selectExpr("id", "id % 3 AS g"), 300, stratify_by="g")
    assert rows(strata) == rows(again)


def test_no_chunks(spark, tmp_path):
    from plumbline.streaming.chunks import read_chunks, sample_chunks

    (tmp_path / "in").mkdir()
    found = sample_chunks(read_chunks(spark, str(tmp_path / "in"), "a long"), str(tmp_path / "out"), 5)
    assert found.count() == 0 and found.columns == ["a"]
