"""Column roles, likely identifiers, correlated columns and date checks."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import (
    INTEGRAL,
    ColumnInfo,
    as_double,
    describe_columns,
    literal,
    literal_frame,
    numeric_columns,
    quoted,
    schema_frame,
)
from plumbline.plans.frequency import distinct_counts
from plumbline.plans.products import block_sums, correlations

#: With more columns than this, pairs come from products of blocks instead of a row per pair.
EXPLODED_COLUMNS = 24

# The name parts of identifier columns and the uniqueness they need.
ID_NAME_PARTS = ("id", "code", "num", "no", "key", "index", "ref")
ID_UNIQUENESS = 0.95

# Text is categorical below this distinct share, or up to this many values.
CATEGORICAL_SHARE = 0.1
CATEGORICAL_VALUES = 50

# Date separators by precedence, and the oldest plausible date.
SEPARATORS = ("/", "-", ".")
OLDEST_DATE = "1900-01-01"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy")


def column_roles(df: DataFrame) -> DataFrame:
    """``column, role``: numeric, datetime, categorical, text or other.

    Booleans count as numeric. Only text columns are read.
    """
    infos = describe_columns(df)
    roles = schema_frame(df.sparkSession, infos)
    texts = [c for c in infos if c.family == "text"]
    role = F.when(F.col("family") == "boolean", "numeric").otherwise(F.col("family"))
    if not texts:
        return roles.select("column", role.alias("role"))
    rows = df.count()
    counts = distinct_counts(df, texts).withColumnRenamed("key", "ordinal")
    unique = F.coalesce("unique_count", F.lit(0))
    text = (
        F.when(unique < CATEGORICAL_SHARE * rows, "categorical")
        .when(unique > CATEGORICAL_VALUES, "text")
        .otherwise("categorical")
    )
    role = F.when(F.col("family") == "text", text).otherwise(role)
    # One row per text column.
    return roles.join(F.broadcast(counts), "ordinal", "left").select("column", role.alias("role"))


def potential_ids(df: DataFrame) -> DataFrame:
    """``column, uniqueness_ratio, dtype`` of nearly unique columns named like identifiers."""
    named = [
        c for c in describe_columns(df)
        if c.family != "other" and any(part in c.name.lower() for part in ID_NAME_PARTS)
    ]
    if not named:
        return df.sparkSession.createDataFrame(
            [], "column string, uniqueness_ratio double, dtype string"
        )
    rows = df.count()
    ratio = F.try_divide(F.col("unique_count").cast("double"), F.lit(float(rows)))
    return (
        schema_frame(df.sparkSession, named)
        .join(F.broadcast(distinct_counts(df, named)), F.col("ordinal") == F.col("key"))
        .select("column", ratio.alias("uniqueness_ratio"), "dtype")
        .filter(F.col("uniqueness_ratio") > ID_UNIQUENESS)
    )


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``col1, col2, r``: Pearson over rows where both are present, each pair once.

    NULL where a column is constant. Values are centred on the column means
    first, so plain sums stay accurate; they combine before the shuffle, which
    carries one row per pair and task.
    """
    infos = numeric_columns(df, columns)
    spark = df.sparkSession
    if len(infos) < 2:
        return spark.createDataFrame([], "col1 string, col2 string, r double")
    if len(infos) > EXPLODED_COLUMNS:
        return wide_correlation(df, infos)
    means = df.agg(*[F.expr(f"avg({as_double(c)}) AS m{c.ordinal}") for c in infos]).collect()[0]
    centred = ", ".join(f"{as_double(c)} - {literal(means[f'm{c.ordinal}'] or 0.0)}" for c in infos)
    pairs = list(combinations(range(len(infos)), 2))
    left, right = (", ".join(str(p[side]) for p in pairs) for side in (0, 1))
    # One array per row; a pair picks its two values by position.
    sums = (
        df.selectExpr(f"array({centred}) AS v")
        .selectExpr("v", f"posexplode(array({left})) AS (key, a)")
        .selectExpr("key", "get(v, a) AS x", f"get(v, get(array({right}), key)) AS y")
        .filter("x IS NOT NULL AND y IS NOT NULL")
        .groupBy("key")
        .agg(
            F.expr("cast(count(1) AS double) AS n"),
            F.expr("sum(x) AS sx"),
            F.expr("sum(y) AS sy"),
            F.expr("sum(x * x) AS sxx"),
            F.expr("sum(y * y) AS syy"),
            F.expr("sum(x * y) AS sxy"),
        )
    )
    names = literal_frame(
        spark,
        [(i, infos[a].name, infos[b].name) for i, (a, b) in enumerate(pairs)],
        "key int, col1 string, col2 string",
    )
    r = F.expr(
        "try_divide(n * sxy - sx * sy, "
        "sqrt(greatest(n * sxx - sx * sx, 0D)) * sqrt(greatest(n * syy - sy * sy, 0D)))"
    )
    # One row per pair of columns.
    return names.join(F.broadcast(sums), "key", "left").select("col1", "col2", r.alias("r"))


def wide_correlation(df: DataFrame, infos: list[ColumnInfo]) -> DataFrame:
    """:func:`correlation_pairs` of many columns, from products of blocks of columns."""
    found = correlations(block_sums(df, [as_double(c) for c in infos]), len(infos))
    names = F.array(*[F.lit(c.name) for c in infos])
    return found.select(names[F.col("a")].alias("col1"), names[F.col("b")].alias("col2"), "r")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The full square matrix as ``col1, col2, r``, for a heat map."""
    infos = numeric_columns(df, columns)
    pairs = correlation_pairs(df, columns)
    if len(infos) < 2:
        return pairs
    spread = df.agg(*[F.expr(f"stddev_samp({as_double(c)}) AS s{c.ordinal}") for c in infos])
    cells = ", ".join(
        f"named_struct('col1', {literal(c.name)}, 'col2', {literal(c.name)}, "
        f"'r', CASE WHEN s{c.ordinal} > 0 THEN 1D END)"
        for c in infos
    )
    diagonal = spread.selectExpr(f"inline(array({cells}))")
    mirrored = pairs.selectExpr(
        "inline(array(named_struct('col1', col1, 'col2', col2, 'r', r), "
        "named_struct('col1', col2, 'col2', col1, 'r', r)))"
    )
    return mirrored.unionByName(diagonal)


def duplicate_columns(df: DataFrame, threshold: float = 0.95) -> list[list[str]]:
    """Groups of columns that correlate above ``threshold`` with the group's first column.

    A column may sit in several groups, but one that sits in a group heads none.
    The pairs above the threshold come to the driver: bounded by the schema.
    """
    infos = numeric_columns(df)
    if len(infos) < 2:
        return []
    close = {
        (r["col1"], r["col2"])
        for r in correlation_pairs(df).filter(F.abs("r") > threshold).collect()
    }
    names = [c.name for c in infos]
    groups, taken = [], set()
    for i, head in enumerate(names):
        if head in taken:
            continue
        members = [other for other in names[i + 1 :] if (head, other) in close]
        taken.update(members)
        if members:
            groups.append([head, *members])
    return groups


def duplicate_column_table(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``group_id, column`` of :func:`duplicate_columns`."""
    rows = [(g, c) for g, group in enumerate(duplicate_columns(df, threshold)) for c in group]
    return literal_frame(df.sparkSession, rows, "group_id int, column string")


def parse_date(info: ColumnInfo, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The column as timestamp without zone, NULL where it does not parse.

    Whole numbers are nanoseconds since 1970.
    """
    col = quoted(info.name)
    if info.family == "datetime":
        return col.cast("timestamp_ntz")
    if isinstance(info.type, INTEGRAL):
        return F.timestamp_micros(F.floor(col / 1000).cast("bigint")).cast("timestamp_ntz")
    if info.family != "text":
        return F.lit(None).cast("timestamp_ntz")
    attempts = [col.try_cast("timestamp_ntz")]
    attempts += [F.try_to_timestamp(col, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*attempts)


def date_consistency(
    df: DataFrame, columns: list[str], as_of=None, formats: tuple[str, ...] = DATE_FORMATS
) -> DataFrame:
    """Validity, range, future and pre-1900 dates and mixed separators, per column.

    Absent columns are skipped; a column without a valid date has only its
    status and counts. One scan, one aggregate row.
    """
    infos = describe_columns(df, columns)
    limit = F.localtimestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp_ntz")
    aggs, cells = [F.count(F.lit(1)).alias("total")], []
    for info in infos:
        i, date = info.ordinal, parse_date(info, formats)
        aggs += [
            F.count(date).alias(f"n{i}"),
            F.min(date).alias(f"lo{i}"),
            F.max(date).alias(f"hi{i}"),
            F.count_if(date > limit).alias(f"future{i}"),
            F.count_if(date < F.lit(OLDEST_DATE).cast("timestamp_ntz")).alias(f"old{i}"),
            *_separator_counts(info),
        ]
        valid = F.col(f"n{i}") > 0
        cells.append(
            F.struct(
                F.lit(info.name).alias("column"),
                F.when(valid, "ok").otherwise("no_valid_dates").alias("status"),
                F.col(f"lo{i}").alias("min_date"),
                F.col(f"hi{i}").alias("max_date"),
                F.timestamp_diff("DAY", F.col(f"lo{i}"), F.col(f"hi{i}")).alias("date_range_days"),
                F.when(valid, F.col(f"future{i}")).alias("future_dates"),
                F.when(valid, F.col(f"old{i}")).alias("past_century_dates"),
                F.col(f"n{i}").alias("valid_date_count"),
                (F.col("total") - F.col(f"n{i}")).alias("invalid_date_count"),
                _separators(info).alias("separators"),
                (F.size(_separators(info)) > 1).alias("mixed_separators"),
            )
        )
    if not cells:
        raise ValueError("none of the date columns is in the table")
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def _separator_counts(info: ColumnInfo) -> list[Column]:
    if info.family != "text":
        return []
    col = quoted(info.name)
    counts, earlier = [], F.lit(False)
    for j, mark in enumerate(SEPARATORS):
        here = F.contains(col, F.lit(mark))
        counts.append(F.count_if(here & ~earlier).alias(f"sep{info.ordinal}_{j}"))
        earlier = earlier | here
    return counts


def _separators(info: ColumnInfo) -> Column:
    if info.family != "text":
        return F.expr("cast(array() as array<string>)")
    return F.array_compact(
        F.array(
            *[
                F.when(F.col(f"sep{info.ordinal}_{j}") > 0, F.lit(mark))
                for j, mark in enumerate(SEPARATORS)
            ]
        )
    )


def date_separators(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, separator, values``: how many values use each date separator first."""
    infos = [c for c in describe_columns(df, columns) if c.family == "text"]
    if not infos:
        raise ValueError("none of the columns is a text column of the table")
    row = df.agg(*reduce(lambda a, b: a + b, [_separator_counts(c) for c in infos]))
    cells = [
        F.struct(
            F.lit(c.name).alias("column"),
            F.lit(mark).alias("separator"),
            F.col(f"sep{c.ordinal}_{j}").alias("values"),
        )
        for c in infos
        for j, mark in enumerate(SEPARATORS)
    ]
    return row.select(F.inline(F.array(*cells))).filter("values > 0")
