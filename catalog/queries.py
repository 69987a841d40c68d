"""One query per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.inputs import (
    AS_OF,
    SENTINEL,
    dirty_events,
    dirty_orders,
    drift_pair,
    order_dates,
    order_pair,
    table,
)
from plumbline import Config, analyze, quick_check, validate_thresholds
from plumbline.functions.columns import describe_columns
from plumbline.operators import charts, constraints, drift, issues, profile, repair, report, rows
from plumbline.operators import sampling, structure
from plumbline.sources.tables import (
    as_frame,
    export_analysis,
    load_table,
    sample_large_file,
    shared_folder,
    write_table,
)
from plumbline.streaming.chunks import read_chunks, sample_chunks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
RULES = {
    "l_quantity": {"min": 5, "max": 45},
    "l_discount": {"max": 0.08},
    "l_returnflag": {"allowed": ["A", "N"]},
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Comparable types: rounded doubles, bigints, text for timestamps and lists.

    Averages of prices often lie exactly half-way between two rounding steps,
    where the last bit decides; both engines add the same nudge first.
    """
    out = []
    for f in df.schema.fields:
        col, kind = F.col(f.name), f.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            col = F.round(col.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("bigint")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, STAMP)
        elif isinstance(kind, T.ArrayType):
            col = F.array_join(col.cast("array<string>"), "|")
        out.append(col.alias(f.name))
    return df.select(*out)


NUMERIC = (
    "column", "total_count", "missing_count", "missing_percentage", "unique_count", "mean", "std",
    "min", "max", "median", "q1", "q3", "skew", "kurtosis", "zero_count", "zero_percentage",
)
TEXT = (
    "column", "total_count", "missing_count", "missing_percentage", "unique_count", "most_common",
    "most_common_count", "most_common_percentage", "entropy",
)
DATES = (
    "column", "total_count", "missing_count", "missing_percentage", "unique_count", "min_date",
    "max_date", "date_range_days", "future_dates",
)
ISSUE = ("column", "issue_type", "severity", "message", "affected_count", "affected_percentage")


def _family(df: DataFrame, family: str, columns, as_of=None) -> DataFrame:
    picked = df.select(*[c.name for c in describe_columns(df) if c.family == family])
    return plain(profile.profile(picked, as_of).select(*columns))


# Profile -----------------------------------------------------------------


@query
def profile_numeric(spark, sf):
    return _family(table(spark, sf, "lineitem"), "numeric", NUMERIC)


@query
def profile_numeric_missing(spark, sf):
    return _family(dirty_orders(spark, sf), "numeric", NUMERIC)


@query
def profile_boolean(spark, sf):
    return _family(dirty_events(spark, sf), "boolean", NUMERIC)


@query
def profile_categorical(spark, sf):
    return _family(dirty_orders(spark, sf), "text", TEXT)


@query
def profile_part_text(spark, sf):
    return _family(table(spark, sf, "part"), "text", TEXT)


@query
def profile_long_text(spark, sf):
    return _family(table(spark, sf, "documents"), "text", TEXT)


@query
def profile_pages(spark, sf):
    return _family(table(spark, sf, "pages"), "text", TEXT)


@query
def profile_conversations(spark, sf):
    return _family(table(spark, sf, "conversations"), "text", TEXT)


@query
def profile_datetime(spark, sf):
    return _family(table(spark, sf, "events"), "datetime", DATES, AS_OF)


@query
def profile_nested(spark, sf):
    columns = ("column", "family", "total_count", "missing_count", "unique_count")
    return plain(profile.profile(table(spark, sf, "embeddings")).select(*columns))


@query
def profile_full(spark, sf):
    return plain(analyze(dirty_events(spark, sf), as_of=AS_OF).profile)


@query
def dataset_shape(spark, sf):
    return profile.dataset_shape(table(spark, sf, "customer"))


@query
def summary_statistics(spark, sf):
    return profile.summary_statistics(table(spark, sf, "customer")).select(
        "rows",
        "columns",
        "total_cells",
        "size_bytes",
        F.array_join("column_names", ",").alias("column_names"),
        F.to_json("dtypes_count").alias("dtypes_count"),
    )


@query
def value_counts(spark, sf):
    return profile.column_value_counts(table(spark, sf, "documents"), "source")


@query
def dataset_summary(spark, sf):
    row = analyze(dirty_orders(spark, sf), "orders", as_of=AS_OF).summary()
    first = F.col("missing_columns")[0]
    return plain(
        row.select(
            "dataset", "rows", "columns", "total_cells", "size_bytes", "critical", "warning",
            "info", F.to_json("issues_by_type").alias("issues_by_type"),
            F.to_json("column_types").alias("column_types"), "columns_with_missing",
            "total_missing_cells", "total_missing_percentage",
            first["column"].alias("most_missing"),
        )
    )


@query
def quick_summary(spark, sf):
    return plain(
        quick_check(table(spark, sf, "customer"), "customer").select(
            "dataset", "rows", "columns", "critical", "warning", "info", "columns_with_missing"
        )
    )


@query
def column_report(spark, sf):
    found = analyze(table(spark, sf, "events"), as_of=AS_OF).column_report("value")
    kinds = F.array_sort(F.transform("issues", lambda i: i["issue_type"]))
    return plain(
        found.select("column", "dtype", "mean", "median", "unique_count", kinds.alias("issue_types"))
    )


@query
def missing_overview(spark, sf):
    return plain(profile.missing_overview(profile.missing_counts(dirty_orders(spark, sf))))


@query
def missing_totals(spark, sf):
    return plain(profile.missing_totals(profile.missing_counts(dirty_orders(spark, sf))))


# Issues ------------------------------------------------------------------


def _issues(df, *kinds, config=None):
    found = analyze(df, config=config, as_of=AS_OF).issues
    return plain(found.filter(F.col("issue_type").isin(*kinds)).select(*ISSUE))


@query
def issues_missing(spark, sf):
    return _issues(dirty_orders(spark, sf), "missing_values")


@query
def issues_missing_thresholds(spark, sf):
    return _issues(dirty_orders(spark, sf), "missing_values", config={"missing_critical": 0.5})


@query
def issues_outliers(spark, sf):
    return _issues(table(spark, sf, "documents"), "outliers")


@query
def issues_outliers_critical(spark, sf):
    return _issues(table(spark, sf, "labels"), "outliers")


@query
def issues_outliers_excluding(spark, sf):
    return _issues(
        dirty_events(spark, sf), "outliers", config={"exclude_values": {"value": [SENTINEL]}}
    )


@query
def outlier_examples(spark, sf):
    found = analyze(table(spark, sf, "events"), as_of=AS_OF).issues
    details = found.filter("issue_type = 'outliers'").select("column", "details.*")
    return plain(
        details.select(
            "column", "lower_bound", "upper_bound", "min_value", "max_value",
            F.transform("examples", lambda x: F.format_string("%.2f", x.cast("double"))).alias("examples"),
        )
    )


@query
def issues_skew(spark, sf):
    return _issues(table(spark, sf, "events"), "skewed_distribution")


@query
def issues_cardinality(spark, sf):
    return _issues(table(spark, sf, "lineitem"), "low_cardinality")


@query
def issues_inconsistent(spark, sf):
    return _issues(dirty_events(spark, sf), "inconsistent_values")


@query
def spelling_groups(spark, sf):
    found = analyze(dirty_events(spark, sf), as_of=AS_OF).issues
    picked = found.filter("issue_type = 'inconsistent_values'")
    return plain(
        picked.select(
            "column",
            F.col("details.unique_normalized_values").alias("normalized_values"),
            F.col("details.examples").alias("examples"),
        )
    )


@query
def issues_future(spark, sf):
    return _issues(table(spark, sf, "events"), "future_dates")


@query
def issues_all(spark, sf):
    return plain(analyze(dirty_events(spark, sf), as_of=AS_OF).issues.select(*ISSUE))


@query
def issues_by_severity(spark, sf):
    return issues.issues_by_severity(analyze(dirty_events(spark, sf), as_of=AS_OF).issues)


@query
def issues_by_type(spark, sf):
    return issues.issues_by_type(analyze(dirty_events(spark, sf), as_of=AS_OF).issues)


@query
def issue_chart(spark, sf):
    return charts.issue_chart(analyze(dirty_events(spark, sf), as_of=AS_OF).issues)


@query
def quality_grade(spark, sf):
    return report.quality_grade(analyze(dirty_events(spark, sf), as_of=AS_OF).issues)


@query
def health_score(spark, sf):
    return plain(report.health_score(analyze(dirty_events(spark, sf), as_of=AS_OF).issues))


@query
def recommendations(spark, sf):
    found = analyze(dirty_orders(spark, sf), as_of=AS_OF)
    return report.recommendations(found.profile, found.issues)


@query
def issue_context(spark, sf):
    found = analyze(dirty_orders(spark, sf), as_of=AS_OF)
    return plain(report.issue_context(found.profile, found.issues))


# Rows and constraints ----------------------------------------------------


@query
def rows_missing(spark, sf):
    return plain(rows.problem_rows(dirty_orders(spark, sf), "o_totalprice", "missing_values").drop("o_totalprice"))


@query
def rows_outliers(spark, sf):
    return plain(rows.problem_rows(table(spark, sf, "events"), "value", "outliers"))


@query
def rows_all(spark, sf):
    found = rows.problem_rows(dirty_events(spark, sf), "value", "all")
    return plain(found.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))))


@query
def rows_excluding_sentinels(spark, sf):
    config = Config(exclude_values={"value": [SENTINEL]})
    return plain(rows.problem_rows(dirty_events(spark, sf), "value", "outliers", config))


@query
def rows_any_issue(spark, sf):
    found = analyze(dirty_orders(spark, sf), as_of=AS_OF).any_problem_rows()
    return plain(found.withColumn("o_totalprice", F.nanvl("o_totalprice", F.lit(None).cast("double"))))


@query
def rows_tagged(spark, sf):
    found = rows.any_problem_rows(
        table(spark, sf, "documents"), ["n_chars", "doc_id"], tag="problems"
    )
    return plain(found.select("doc_id", "n_chars", "problems"))


@query
def constraint_report(spark, sf):
    return plain(constraints.constraint_report(table(spark, sf, "lineitem"), RULES))


@query
def constraint_rows(spark, sf):
    found = constraints.constraint_rows(table(spark, sf, "lineitem"), RULES, tag="violated")
    return plain(found)


@query
def constraint_lookup(spark, sf):
    allowed = table(spark, sf, "customer").filter("c_acctbal >= 0")
    found = constraints.not_in_reference(table(spark, sf, "orders"), "o_custkey", allowed, "c_custkey")
    return plain(found)


# Drift -------------------------------------------------------------------


@query
def drift_mean(spark, sf):
    return plain(drift.mean_changes(*drift_pair(spark, sf)))


@query
def drift_profiles(spark, sf):
    left, right = order_pair(spark, sf)
    return plain(drift.compare_profiles(analyze(left).profile, analyze(right).profile))


@query
def drift_psi_numeric(spark, sf):
    return plain(drift.population_stability(*drift_pair(spark, sf), ["event_id", "user_id", "value"]))


@query
def drift_psi_categorical(spark, sf):
    return plain(drift.population_stability(*order_pair(spark, sf), ["o_orderstatus", "o_orderpriority"]))


@query
def drift_psi_boolean(spark, sf):
    return plain(drift.population_stability(*drift_pair(spark, sf), ["is_large"]))


@query
def drift_psi_datetime(spark, sf):
    return plain(drift.population_stability(*order_pair(spark, sf), ["o_orderdate"]))


@query
def drift_ks(spark, sf):
    return plain(drift.kolmogorov_smirnov(*drift_pair(spark, sf), ["event_id", "user_id", "value", "is_large"]))


@query
def drift_table(spark, sf):
    return plain(drift.drift_table(*drift_pair(spark, sf)))


@query
def drift_table_missing(spark, sf):
    return plain(drift.drift_table(*order_pair(spark, sf)))


# Structure ---------------------------------------------------------------


@query
def column_roles(spark, sf):
    return structure.column_roles(table(spark, sf, "part"))


@query
def column_roles_events(spark, sf):
    return structure.column_roles(dirty_events(spark, sf))


@query
def potential_ids(spark, sf):
    return plain(structure.potential_ids(table(spark, sf, "customer")))


@query
def correlation_pairs(spark, sf):
    return plain(structure.correlation_pairs(table(spark, sf, "lineitem")))


@query
def correlation_missing(spark, sf):
    return plain(structure.correlation_pairs(dirty_events(spark, sf)))


@query
def correlation_heatmap(spark, sf):
    return plain(charts.correlation_heatmap(table(spark, sf, "part")))


@query
def duplicate_columns(spark, sf):
    doubled = table(spark, sf, "lineitem").withColumn("qty2", F.expr("l_quantity * 2"))
    return plain(structure.duplicate_column_table(doubled))


@query
def date_consistency(spark, sf):
    return plain(structure.date_consistency(order_dates(spark, sf), ["order_date", "iso_date"], AS_OF))


@query
def date_separators(spark, sf):
    return structure.date_separators(order_dates(spark, sf), ["order_date", "iso_date"])


# Chart tables ------------------------------------------------------------


@query
def missing_patterns(spark, sf):
    return plain(charts.missing_patterns(dirty_orders(spark, sf)))


@query
def missing_bars(spark, sf):
    return plain(charts.missing_bars(profile.missing_counts(dirty_orders(spark, sf))))


@query
def histogram(spark, sf):
    return plain(charts.histogram(dirty_events(spark, sf)))


@query
def distribution_stats(spark, sf):
    return plain(charts.distribution_stats(dirty_events(spark, sf)).drop("ordinal"))


@query
def box_stats(spark, sf):
    return plain(charts.box_stats(dirty_events(spark, sf)))


@query
def top_categories(spark, sf):
    return plain(charts.top_categories(table(spark, sf, "documents"), ["source", "lang"]))


# Sampling, repair, sources -----------------------------------------------


@query
def sample_n(spark, sf):
    whole = table(spark, sf, "events")
    found = sampling.sample_rows(whole, 1000)
    inside = found.join(whole.select("event_id"), "event_id", "left_semi")
    return inside.agg(
        F.count(F.lit(1)).alias("sampled"), F.count_distinct("event_id").alias("distinct_ids")
    )


@query
def sample_stratified(spark, sf):
    found = sampling.sample_rows(table(spark, sf, "events"), 1000, stratify_by="event_type")
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("sampled"))


def _scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def sample_large_csv(spark, sf):
    path = f"{_scratch(spark, 'orders')}.csv"
    write_table(table(spark, sf, "orders"), path)
    found = sample_large_file(spark, path, 500)
    return found.agg(F.count(F.lit(1)).alias("sampled"), F.count_distinct("o_orderkey").alias("distinct_ids"))


@query
def sample_chunk_stream(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = _scratch(spark, "chunks")
    write_table(orders.repartition(4, "o_orderkey"), path, "csv")
    found = sample_chunks(read_chunks(spark, path, orders.schema), _scratch(spark, "sampled"), 300)
    return found.agg(F.count(F.lit(1)).alias("sampled"), F.count_distinct("o_orderkey").alias("distinct_ids"))


@query
def impute_median(spark, sf):
    whole = dirty_events(spark, sf)
    return plain(repair.impute(whole, repair.fit_medians(whole, ["value"])).select("event_id", "value"))


@query
def clip_fences(spark, sf):
    left, _ = drift_pair(spark, sf)
    whole = dirty_events(spark, sf)
    return plain(repair.clip(whole, repair.fit_fences(left, ["value"])).select("event_id", "value"))


def _roundtrip(spark, sf, ending, format=None):
    path = f"{_scratch(spark, 'customer')}{ending}"
    df = table(spark, sf, "customer")
    write_table(df, path, format)
    return plain(load_table(spark, path, format, df.schema))


@query
def roundtrip_csv(spark, sf):
    return _roundtrip(spark, sf, ".csv")


@query
def roundtrip_csv_inferred(spark, sf):
    path = f"{_scratch(spark, 'lineitem')}.CSV"
    line = table(spark, sf, "lineitem")
    write_table(line.withColumn("l_shipdate", F.date_format("l_shipdate", STAMP[:19])), path)
    return plain(load_table(spark, path))


@query
def roundtrip_json(spark, sf):
    return _roundtrip(spark, sf, ".json")


@query
def roundtrip_json_array(spark, sf):
    """Files that hold one array of records each."""
    path = f"{_scratch(spark, 'customer')}.json"
    df = table(spark, sf, "customer")
    array = df.groupBy(F.spark_partition_id()).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    array.select("value").write.text(path)
    return plain(load_table(spark, path, schema=df.schema))


@query
def roundtrip_csv_text(spark, sf):
    """Whole texts with line breaks, quotes and commas; an empty text is not a missing one."""
    path = f"{_scratch(spark, 'documents')}.csv"
    df = table(spark, sf, "documents")
    write_table(df, path)
    return plain(load_table(spark, path, schema=df.schema, missing=()))


@query
def profile_csv_markers(spark, sf):
    """A CSV file whose gaps are written as markers; dates stay text."""
    path = f"{_scratch(spark, 'orders')}.csv"
    orders = table(spark, sf, "orders")
    marked = orders.selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus",
        "CASE o_orderkey % 7 WHEN 0 THEN 'NA' WHEN 3 THEN 'N/A' ELSE cast(o_totalprice AS string) END AS o_totalprice",
        "cast(o_orderdate AS string) AS o_orderdate",
        "CASE o_orderkey % 5 WHEN 0 THEN 'null' WHEN 1 THEN '' ELSE o_orderpriority END AS o_orderpriority",
    )
    write_table(marked, path)
    found = analyze(load_table(spark, path), "orders").profile
    return plain(found.select("column", "dtype", "missing_count", "unique_count", "mean", "median"))


@query
def view_by_name(spark, sf):
    """An upstream table given by its name in the catalog."""
    name = f"orders_{uuid.uuid4().hex}"
    table(spark, sf, "orders").createOrReplaceTempView(name)
    return plain(profile.column_value_counts(as_frame(spark, name), "o_orderstatus"))


@query
def issues_thresholds(spark, sf):
    """Thresholds merged over the defaults; one out of range warns and keeps its default."""
    merged = validate_thresholds({"missing_warning": 0.2, "missing_critical": 1.5, "unknown": 3})
    return _issues(dirty_orders(spark, sf), "missing_values", config=merged)


@query
def constraints_from_table(spark, sf):
    """The same rules, read from a rules table."""
    line = [
        (c, kind, [str(x) for x in (v if kind == "allowed" else [v])])
        for c, rule in RULES.items()
        for kind, v in rule.items()
    ]
    rules = spark.createDataFrame(line, "column string, kind string, args array<string>")
    found = constraints.constraint_report(table(spark, sf, "lineitem"), constraints.rules_from_table(rules))
    return plain(found)


@query
def roundtrip_jsonl(spark, sf):
    return _roundtrip(spark, sf, ".jsonl")


@query
def roundtrip_parquet(spark, sf):
    return _roundtrip(spark, sf, ".parquet")


@query
def roundtrip_orc(spark, sf):
    return _roundtrip(spark, sf, "", "orc")


@query
def export_bad_rows(spark, sf):
    path = f"{_scratch(spark, 'bad')}.csv"
    found = rows.problem_rows(table(spark, sf, "documents"), "n_chars", "outliers")
    write_table(found, path)
    return plain(load_table(spark, path, schema=found.schema, missing=()))


@query
def export_results(spark, sf):
    path = _scratch(spark, "analysis")
    export_analysis(analyze(dirty_events(spark, sf), as_of=AS_OF), path)
    return plain(load_table(spark, f"{path}/issues", "jsonl").select(*ISSUE))
