"""The column profile and the tables derived from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import MAX_MISSING_COLUMNS
from plumbline.functions.columns import (
    CATEGORY,
    ColumnInfo,
    as_double,
    clean,
    describe_columns,
    ident,
    literal,
    literal_frame,
    quoted,
    schema_frame,
    without,
)
from plumbline.functions.stats import percentage, with_shape
from plumbline.operators.states import HLL_LG, value_hash
from plumbline.plans.frequency import distinct_counts, long_modes, text_summary, value_counts
from plumbline.plans.heavy import sketched_modes
from plumbline.plans.orderstats import order_statistics, proposed_statistics

QUARTILES = (0.25, 0.5, 0.75)

# Keys at and above this belong to a column without its excluded values.
KEPT = 1_000_000

PROFILE_COLUMNS = (
    "column", "ordinal", "dtype", "family", "total_count", "missing_count",
    "missing_percentage", "unique_count", "mean", "std", "min", "max", "median", "q1", "q3",
    "skew", "kurtosis", "zero_count", "zero_percentage", "most_common", "most_common_count",
    "most_common_percentage", "entropy", "min_date", "max_date", "date_range_days",
    "future_dates", "min_exact", "max_exact",
)

# Bytes of one present value of a fixed-width type.
FIXED_WIDTH = {
    "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
    "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def is_future(info: ColumnInfo, as_of=None) -> str:
    """Strictly after ``as_of``, by default after now."""
    col = ident(info.name)
    if as_of is not None:
        return f"cast({col} AS timestamp_ntz) > timestamp_ntz {literal(str(as_of))}"
    if info.dtype == "timestamp":
        return f"{col} > current_timestamp()"
    return f"cast({col} AS timestamp_ntz) > localtimestamp()"


def _numeric_entries(infos: list[ColumnInfo], excluded=None) -> list[tuple[int, str]]:
    """Key and value per column; a column with excluded values has a second entry
    without them, keyed ``KEPT + ordinal``."""
    entries = []
    for info in infos:
        value = as_double(info)
        entries.append((info.ordinal, value))
        skip = (excluded or {}).get(info.name)
        if skip:
            entries.append((KEPT + info.ordinal, without(value, skip)))
    return entries


def _named(stats: DataFrame) -> DataFrame:
    flag = ["missed"] if "missed" in stats.columns else []
    return with_shape(stats).selectExpr(
        "key", "n", "mean", "std", "skew", "kurtosis", "min", "max",
        "q0 AS q1", "q1 AS median", "q2 AS q3", "zero_count", *flag,
    )


def numeric_summary(df: DataFrame, infos: list[ColumnInfo], excluded=None) -> DataFrame:
    """Exact moments and quartiles of the numeric and boolean columns, by ``key``."""
    entries = _numeric_entries(infos, excluded)
    return _named(order_statistics(df, entries, QUARTILES, moments=True))


def _rows(df: DataFrame, aggs: list[str], cells: list[str]) -> DataFrame:
    """One aggregate row over ``df``, unfolded into one row per struct of ``cells``."""
    return df.agg(*map(F.expr, aggs)).selectExpr(f"inline(array({', '.join(cells)}))")


def datetime_summary(df: DataFrame, infos: list[ColumnInfo], as_of=None) -> DataFrame:
    """Count, range and future dates of the datetime columns, from one aggregate row."""
    aggs, cells = [], []
    for info in infos:
        i, col = info.ordinal, ident(info.name)
        aggs += [
            f"count({col}) AS n{i}",
            f"min({col}) AS lo{i}",
            f"max({col}) AS hi{i}",
            f"count_if({is_future(info, as_of)}) AS f{i}",
        ]
        cells.append(
            f"named_struct('key', {i}, 'n', n{i}, 'min_date', cast(lo{i} AS timestamp_ntz), "
            f"'max_date', cast(hi{i} AS timestamp_ntz), "
            f"'date_range_days', timestampdiff(DAY, lo{i}, hi{i}), 'future_dates', f{i})"
        )
    return _rows(df, aggs, cells)


def present_counts(df: DataFrame, infos: list[ColumnInfo]) -> DataFrame:
    """``key, n``: non-missing values per column, from one aggregate row."""
    return _rows(
        df,
        [f"count({clean(c)}) AS n{c.ordinal}" for c in infos],
        [f"named_struct('key', {c.ordinal}, 'n', n{c.ordinal})" for c in infos],
    )


def approximate_distinct(df: DataFrame, infos: list[ColumnInfo]) -> DataFrame:
    """``key, unique_count`` from HyperLogLog sketches: one aggregate row, no shuffle by value.

    The standard error is below 0.6 %.
    """
    aggs = [f"hll_sketch_estimate(hll_sketch_agg({value_hash(c)}, {HLL_LG})) AS u{c.ordinal}" for c in infos]
    cells = [f"named_struct('key', {c.ordinal}, 'unique_count', u{c.ordinal})" for c in infos]
    return _rows(df, aggs, cells)


def approximate_text_summary(df: DataFrame, infos: list[ColumnInfo]) -> DataFrame:
    """Count, estimated distinct count and, where it is certain, the exact mode of the text columns.

    A mode is certain if its exact count is above what the sketch of frequent values leaves to any other value.
    """
    aggs = [f"count({ident(c.name)}) AS n{c.ordinal}" for c in infos]
    cells = [f"named_struct('key', {c.ordinal}, 'n', n{c.ordinal})" for c in infos]
    counts = _rows(df, aggs, cells).join(F.broadcast(approximate_distinct(df, infos)), "key")  # a row per column
    modes = sketched_modes(df, infos)
    return counts.join(F.broadcast(modes), "key", "left").withColumn("mode_long", F.lit(False))


def exact_range(df: DataFrame, infos: list[ColumnInfo]) -> DataFrame:
    """``key, min_exact, max_exact``: the range of integer and decimal columns as text, which doubles may not hold."""
    aggs, cells = [], []
    for c in infos:
        aggs += [f"min({ident(c.name)}) AS lo{c.ordinal}", f"max({ident(c.name)}) AS hi{c.ordinal}"]
        cells.append(
            f"named_struct('key', {c.ordinal}, 'min_exact', cast(lo{c.ordinal} AS string), 'max_exact', cast(hi{c.ordinal} AS string))"
        )
    return _rows(df, aggs, cells)


def column_facts(
    df: DataFrame,
    as_of=None,
    excluded: dict[str, list] | None = None,
    approx_distinct: bool = False,
) -> DataFrame:
    """The statistics of every column by ``key``: one query, cached, a row per column.

    With ``approx_distinct`` distinct counts are estimates that shuffle no value;
    entropy and spelling groups, which need the values, are left out.

    The families of columns are independent branches of one plan, so Spark runs
    their stages side by side. Afterwards two rare cases are settled: a
    quantile bracket that missed its rank, and a long text mode.
    """
    infos = describe_columns(df)
    by_family: dict[str, list[ColumnInfo]] = {}
    for c in infos:
        by_family.setdefault(c.family, []).append(c)
    numbers = by_family.get("numeric", []) + by_family.get("boolean", [])
    texts, dates = by_family.get("text", []), by_family.get("datetime", [])
    # A double holds all values of the narrower types.
    whole = [c for c in numbers if c.dtype == "bigint" or c.dtype.startswith("decimal")]

    def assemble(numeric: DataFrame | None) -> DataFrame:
        parts = [numeric] if numeric is not None else []
        if texts:
            parts.append(approximate_text_summary(df, texts) if approx_distinct else text_summary(df, texts, excluded))
        if dates:
            parts.append(datetime_summary(df, dates, as_of))
        if by_family.get("other"):
            parts.append(present_counts(df, by_family["other"]))
        facts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if numbers or dates:
            count = approximate_distinct if approx_distinct else distinct_counts
            # One row per column.
            facts = facts.join(F.broadcast(count(df, numbers + dates).toDF("key", "n_distinct")), "key", "left")
        # A row per column: one partition, so that later reads are one task.
        return facts.repartition(1).persist()

    flags = ["key"]
    if numbers:
        entries = _numeric_entries(numbers, excluded)
        proposed, _ = proposed_statistics(df, entries, QUARTILES, moments=True)
        facts = assemble(_named(proposed))
        flags += ["missed", "min", "max"]
    else:
        facts = assemble(None)
    if texts:
        flags += ["mode_long", "most_common", "most_common_count"]
    found = facts.select(*flags).collect()
    if numbers and any(r["missed"] for r in found):
        facts.unpersist()
        facts = assemble(numeric_summary(df, numbers, excluded))
        found = facts.select(*[f for f in flags if f != "missed"]).collect()
    if texts:
        heads = {r["key"]: (r["most_common"], r["most_common_count"]) for r in found if r["mode_long"]}
        if heads:
            modes = F.broadcast(long_modes(df, texts, heads))  # one row per text column
            kept = [c for c in facts.columns if c not in ("key", "most_common")]
            facts = facts.join(modes, "key", "left").selectExpr(
                "key", *kept, "coalesce(long_value, most_common) AS most_common"
            )
            facts = facts.persist()
    if whole:
        # Below 2^53 a double is the integer itself; only other ends are looked up again.
        ends = {r["key"]: max(abs(r["min"]), abs(r["max"])) for r in found if r["min"] is not None}
        beyond = [c for c in whole if c.dtype != "bigint" or ends.get(c.ordinal, 0) >= 2**53]
        held = ", ".join(str(c.ordinal) for c in whole if c not in beyond) or "-1"
        text = "CASE WHEN key IN ({}) THEN cast(cast({} AS bigint) AS string) END AS {}_exact"
        facts = facts.selectExpr("*", *[text.format(held, e, e) for e in ("min", "max")])
        if beyond:
            looked = exact_range(df, beyond).toDF("key", "__low", "__high")  # a row per column
            facts = facts.join(F.broadcast(looked), "key", "left").withColumns(
                {"min_exact": F.expr("coalesce(__low, min_exact)"), "max_exact": F.expr("coalesce(__high, max_exact)")}
            ).drop("__low", "__high")
    # Columns without any value have no row yet.
    absent = sorted({c.ordinal for c in infos} - {r["key"] for r in found})
    if absent:
        empty = literal_frame(df.sparkSession, [(k, 0) for k in absent], "key int, n long")
        facts = facts.unionByName(empty, allowMissingColumns=True)
    return facts


def profile(
    df: DataFrame,
    as_of=None,
    excluded: dict[str, list] | None = None,
    rows: int | None = None,
    facts: DataFrame | None = None,
    approx_distinct: bool = False,
) -> DataFrame:
    """One row per column, in the :data:`PROFILE_COLUMNS` layout.

    ``min_exact`` and ``max_exact`` are the range of bigint and decimal columns as text.

    ``facts`` passes in :func:`column_facts` computed already.
    """
    infos = describe_columns(df)
    rows = df.count() if rows is None else rows
    if facts is None:
        facts = column_facts(df, as_of, excluded, approx_distinct)
    have = set(facts.columns)
    names = ", ".join(
        f"{c.ordinal}, struct({literal(c.name)}, {literal(c.dtype)}, {literal(c.family)})" for c in infos
    )
    known = facts.filter(f"key < {KEPT}").selectExpr("*", f"map({names})[key] AS info")
    total = f"{rows}L"
    unique = ", ".join(c for c in ("unique_count", "n_distinct") if c in have)
    derived = {
        "column": "info.col1",
        "ordinal": "key",
        "dtype": "info.col2",
        "family": "info.col3",
        "total_count": total,
        "missing_count": f"{total} - n",
        "missing_percentage": percentage(f"({total} - n)", total),
        "unique_count": f"CASE WHEN info.col3 != 'other' THEN coalesce({unique + ', ' if unique else ''}0L) END",
        # quartiles of a boolean are not reported
        "q1": "CASE WHEN info.col3 = 'numeric' THEN q1 END",
        "q3": "CASE WHEN info.col3 = 'numeric' THEN q3 END",
        "zero_percentage": "try_divide(zero_count, n) * 100",
        "most_common_percentage": "try_divide(most_common_count, n) * 100",
    }
    needs = {
        "q1": "q1", "q3": "q3", "zero_percentage": "zero_count",
        "most_common_percentage": "most_common_count",
    }
    types = {
        "zero_count": "long", "most_common": "string", "most_common_count": "long",
        "min_date": "timestamp_ntz", "max_date": "timestamp_ntz", "date_range_days": "long",
        "future_dates": "long", "min_exact": "string", "max_exact": "string",
    }
    out = []
    for name in PROFILE_COLUMNS:
        if name in derived and needs.get(name, "key") in have:
            out.append(f"{derived[name]} AS `{name}`")
        elif name in have:
            out.append(f"`{name}`")
        else:
            out.append(f"cast(NULL AS {types.get(name, 'double')}) AS `{name}`")
    return known.selectExpr(*out)


def logical_bytes(df: DataFrame) -> Column:
    """Aggregate expression: bytes of the present values (text by its UTF-8 length)."""
    total = F.lit(0).cast("long")
    for info in describe_columns(df):
        col = quoted(info.name)
        if info.family == "text":
            size = F.sum(F.octet_length(col)).cast("long")
        elif info.dtype in FIXED_WIDTH:
            size = F.count(col) * FIXED_WIDTH[info.dtype]
        elif info.dtype == "binary":
            size = F.sum(F.octet_length(col)).cast("long")
        elif info.dtype.startswith("decimal"):
            size = F.count(col) * (8 if info.type.precision <= 18 else 16)
        else:  # nested: the size of its JSON text
            size = F.sum(F.octet_length(F.to_json(F.struct(col)))).cast("long")
        total = total + F.coalesce(size, F.lit(0).cast("long"))
    return total


def dataset_shape(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells and logical size."""
    width = len(df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(width).cast("long").alias("columns"),
        (F.count(F.lit(1)) * width).alias("total_cells"),
        logical_bytes(df).alias("size_bytes"),
    )


def dtype_counts(df: DataFrame) -> DataFrame:
    """``dtype, columns``: columns per data type."""
    return (
        schema_frame(df.sparkSession, describe_columns(df))
        .groupBy("dtype")
        .agg(F.count(F.lit(1)).alias("columns"))
    )


def summary_statistics(df: DataFrame) -> DataFrame:
    """One row: the shape, the columns per data type and the column names."""
    counts: dict[str, int] = {}
    for c in describe_columns(df):
        counts[c.dtype] = counts.get(c.dtype, 0) + 1
    types = F.create_map(*[F.lit(x) for dtype in sorted(counts) for x in (dtype, counts[dtype])])
    return dataset_shape(df).select(
        "*", types.alias("dtypes_count"), F.array(*map(F.lit, df.columns)).alias("column_names")
    )


def type_counts(df: DataFrame) -> DataFrame:
    """``category, columns``: numeric, categorical, datetime, boolean, other."""
    pairs = [(CATEGORY[c.family],) for c in describe_columns(df)]
    return (
        literal_frame(df.sparkSession, pairs, "category string")
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("columns"))
    )


def missing_counts(df: DataFrame) -> DataFrame:
    """``column, ordinal, total_count, missing_count, missing_percentage`` in one pass."""
    infos = describe_columns(df)
    aggs = ["count(1) AS total"] + [f"count({clean(c)}) AS n{c.ordinal}" for c in infos]
    cells = [
        f"named_struct('column', {literal(c.name)}, 'ordinal', {c.ordinal}, 'total_count', total, "
        f"'missing_count', total - n{c.ordinal})"
        for c in infos
    ]
    share = percentage("missing_count", "total_count")
    return _rows(df, aggs, cells).selectExpr("*", f"{share} AS missing_percentage")


def missing_totals(missing: DataFrame) -> DataFrame:
    """One row: columns with missing values, missing cells, and their share of all cells.

    Takes :func:`missing_counts` or a profile; both have one row per column.
    """
    share = percentage("sum(missing_count)", "sum(total_count)")
    return missing.agg(
        F.expr("count_if(missing_count > 0) AS columns_with_missing"),
        F.expr("sum(missing_count) AS total_missing_cells"),
        F.expr(f"{share} AS total_missing_percentage"),
    )


def missing_overview(missing: DataFrame, limit: int = MAX_MISSING_COLUMNS) -> DataFrame:
    """The columns with the highest share of missing values, ties in table order."""
    return (
        missing.filter("missing_count > 0")
        .orderBy(F.desc("missing_percentage"), "ordinal")
        .limit(limit)
        .select("column", "missing_count", "missing_percentage")
    )


def column_value_counts(df: DataFrame, column: str) -> DataFrame:
    """``column, value, cnt``: all values of one column with their counts."""
    infos = describe_columns(df, [column])
    if not infos:
        raise ValueError(f"column {column!r} is not in the table")
    return value_counts(df, infos).select(F.lit(column).alias("column"), "value", "cnt")
