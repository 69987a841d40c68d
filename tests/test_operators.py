"""Structure, chart tables, sampling, repair, sources and chunked input."""

import datetime as dt
import glob
import json

import pytest

from plumbline import analyze, load_table, sample_rows, write_table
from plumbline.operators import charts, repair, structure
from plumbline.sources.tables import as_frame, export_analysis, format_of, sample_large_file
from plumbline.streaming.chunks import read_chunks, sample_chunks


def test_duplicate_columns(spark):
    df = spark.range(100).selectExpr("id AS col1", "id AS col2", "rand(1) AS col3", "5 AS fixed")
    assert structure.duplicate_columns(df, 0.99) == [["col1", "col2"]]
    pairs = {(r["col1"], r["col2"]): r["r"] for r in structure.correlation_pairs(df).collect()}
    assert pairs["col1", "col2"] == pytest.approx(1.0) and pairs["col1", "fixed"] is None
    assert structure.duplicate_columns(df.select("col1")) == []


def test_correlation_of_shared_rows_only(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (2.0, 4.0), (3.0, None), (float("nan"), 9.0), (4.0, 8.0)], "a double, b double"
    )
    assert structure.correlation_pairs(df).collect()[0]["r"] == pytest.approx(1.0)


def test_potential_ids(spark):
    df = spark.range(100).selectExpr("id", "id + 5 AS customer_id", "cast(id AS string) AS name", "id % 3 AS code")
    assert {r["column"] for r in structure.potential_ids(df).collect()} == {"id", "customer_id"}


def test_column_roles(spark):
    df = spark.range(200).selectExpr(
        "id", "id % 2 = 0 AS flag", "cast(id % 5 AS string) AS few", "cast(id AS string) AS many",
        "current_timestamp() AS at", "array(id) AS list",
    )
    roles = {r["column"]: r["role"] for r in structure.column_roles(df).collect()}
    assert roles == {
        "id": "numeric", "flag": "numeric", "few": "categorical", "many": "text",
        "at": "datetime", "list": "other",
    }


def test_date_checks(spark):
    data = [("2020-01-01", "x"), ("2020/06/01", "y"), ("1850-05-05", "z"), ("bad", None), (None, None)]
    df = spark.createDataFrame(data, "d string, e string")
    rows = {r["column"]: r for r in structure.date_consistency(df, ["d", "e", "absent"], "2020-03-01").collect()}
    d = rows["d"]
    assert (d["valid_date_count"], d["invalid_date_count"]) == (3, 2)
    assert (d["future_dates"], d["past_century_dates"]) == (1, 1)
    assert d["mixed_separators"] and d["separators"] == ["/", "-"]
    assert d["min_date"] == dt.datetime(1850, 5, 5)
    assert rows["e"]["status"] == "no_valid_dates" and set(rows) == {"d", "e"}


def test_histogram_keeps_every_value(column):
    df = column([float(i) for i in range(300)] + [None])
    rows = charts.histogram(df).collect()
    assert len(rows) == 30 and sum(r["cnt"] for r in rows) == 300
    fixed = charts.histogram(column([2.0] * 5)).collect()
    assert len(fixed) == 10 and sum(r["cnt"] for r in fixed) == 5


def test_top_categories_roll_up(column):
    values = [f"v{i:02d}" for i in range(20) for _ in range(40 - i)]
    rows = charts.top_categories(column(values, "string")).collect()
    assert len(rows) == 15 and sum(r["cnt"] for r in rows) == len(values)
    other = [r for r in rows if r["is_other"]]
    assert other[0]["category"] == "Other" and other[0]["cnt"] == sum(40 - i for i in range(14, 20))


def test_missing_patterns(spark):
    df = spark.createDataFrame([(1.0, None), (None, "a"), (float("nan"), "b")], "a double, b string")
    rows = {r["pattern"]: r["rows"] for r in charts.missing_patterns(df).collect()}
    assert rows == {"01": 1, "10": 2}


def test_box_stats_has_no_floor(column):
    row = charts.box_stats(column([1.0, 2.0, 3.0, 4.0, 100.0])).collect()[0]
    assert row["outlier_count"] == 1 and row["outlier_percentage"] == 20.0


def test_sample_size_subset_and_seed(spark):
    df = spark.range(10_000).toDF("id").repartition(5)
    found = {r["id"] for r in sample_rows(df, 500).collect()}
    assert len(found) == 500 and found <= set(range(10_000))
    assert found == {r["id"] for r in sample_rows(df, 500).collect()}
    assert found != {r["id"] for r in sample_rows(df, 500, seed=1).collect()}
    assert sample_rows(df, 20_000).count() == 10_000


def test_sample_of_copies_is_proportional(spark):
    df = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS id").repartition(4)
    copies = sample_rows(df, 900).filter("id = -1").count()
    assert 230 < copies < 370


def test_stratified_sample(spark):
    df = spark.range(2000).selectExpr(
        "id", "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 < 7 THEN 'big' ELSE 'small' END AS kind"
    )
    rows = {r["kind"]: r["count"] for r in sample_rows(df, 200, stratify_by="kind").groupBy("kind").count().collect()}
    assert rows == {"big": 120, "small": 60}


def test_impute_and_clip(spark):
    ref = spark.createDataFrame([(float(v),) for v in range(1, 12)], "v double")
    cur = spark.createDataFrame([(None,), (float("nan"),), (100.0,), (-100.0,), (5.0,)], "v double")
    filled = [r["v"] for r in repair.impute(cur, repair.fit_medians(ref, ["v"])).collect()]
    assert filled == [6.0, 6.0, 100.0, -100.0, 5.0]
    clipped = [r["v"] for r in repair.clip(cur, repair.fit_fences(ref, ["v"])).collect()]
    assert clipped == [None, None, 16.0, -4.0, 5.0]


@pytest.mark.parametrize("ending", (".csv", ".jsonl", ".parquet", ".PQ"))
def test_formats_round_trip(spark, tmp_path, ending):
    data = [(1, "a", 1.5), (2, None, None)]
    df = spark.createDataFrame(data, "id long, name string, age double")
    path = str(tmp_path / f"t{ending}")
    write_table(df, path)
    assert sorted(map(tuple, load_table(spark, path, schema=df.schema).collect())) == data


def test_json_array_and_inferred_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "v": 2.5}, {"id": 2, "v": None}]))
    assert load_table(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "b.CSV").write_text("id,v\n1,2.5\n2,\n")
    df = load_table(spark, str(tmp_path / "b.CSV"))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double"]
    with pytest.warns(UserWarning):
        assert format_of("data.unknown") == "csv"
    with pytest.raises(ValueError):
        format_of("book.xlsx")


def test_sample_of_a_file(spark, tmp_path):
    path = str(tmp_path / "big.csv")
    write_table(spark.range(3000).toDF("id"), path)
    assert sample_large_file(spark, path, 100).count() == 100
    with pytest.warns(UserWarning):
        assert sample_large_file(spark, str(tmp_path / "none.csv"), 100).count() == 0


def test_upstream_frames(spark):
    df = spark.range(3).toDF("id")
    df.createOrReplaceTempView("upstream")
    assert as_frame(spark, df) is df and as_frame(spark, "upstream").count() == 3


def test_export(spark, tmp_path, column):
    export_analysis(analyze(column([1.0, None])), str(tmp_path / "out"))
    lines = [l for p in glob.glob(str(tmp_path / "out/profile/*.json")) for l in open(p)]
    assert json.loads(lines[0])["column"] == "x"


def test_chunks(spark, tmp_path):
    source, out = str(tmp_path / "chunks"), str(tmp_path / "out")
    write_table(spark.range(2000).toDF("id").repartition(5), source, "csv")
    first = sample_chunks(read_chunks(spark, source, "id long"), out, 150)
    assert first.count() == 150 and first.distinct().count() == 150
    spread = first.selectExpr("avg(id) AS m").collect()[0]["m"]
    assert 750 < spread < 1250
    spark.range(2000, 2400).toDF("id").write.mode("append").csv(source, header=True)
    later = sample_chunks(read_chunks(spark, source, "id long"), out, 150)
    assert later.count() == 150 and later.filter("id >= 2000").count() > 0
