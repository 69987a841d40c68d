"""The tables behind the charts; drawing them is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import MAX_CATEGORIES
from plumbline.functions.columns import as_double, clean, describe_columns, literal, literal_frame, numeric_columns
from plumbline.functions.stats import percentage
from plumbline.operators.issues import issues_by_severity, issues_by_type
from plumbline.operators.profile import QUARTILES, missing_overview, numeric_summary
from plumbline.operators.structure import correlation_matrix
from plumbline.plans.bins import double_array, with_position
from plumbline.plans.heavy import top_values
from plumbline.plans.longform import melt
from plumbline.plans.orderstats import order_statistics

# Histogram bins (one per ten values within limits), skew classes,
# the bar colours' levels, the types shown, and the box plot's fence multiplier.
MIN_BINS, MAX_BINS, VALUES_PER_BIN = 10, 50, 10
HIGH_SKEW, MODERATE_SKEW = 1.0, 0.5
CRITICAL_PERCENT, WARNING_PERCENT = 30.0, 5.0
MAX_TYPES = 10
BOX_FENCE = 1.5


def missing_patterns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``pattern, missing_columns, rows``: which columns are missing together, how often.

    The pattern has one 0 or 1 per column in table order. Rows combine by
    pattern before the shuffle.
    """
    infos = describe_columns(df, columns)
    bits = F.concat(*[F.expr(f"CASE WHEN {clean(c)} IS NULL THEN '1' ELSE '0' END") for c in infos])
    names = F.array_compact(
        F.array(
            *[
                F.when(F.substring("pattern", i + 1, 1) == "1", F.lit(c.name))
                for i, c in enumerate(infos)
            ]
        )
    )
    return (
        df.groupBy(bits.alias("pattern"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("pattern", names.alias("missing_columns"), "rows")
    )


def missing_bars(missing: DataFrame) -> DataFrame:
    """The missing-data overview with the level each bar is coloured by."""
    percent = F.col("missing_percentage")
    level = (
        F.when(percent > CRITICAL_PERCENT, "critical")
        .when(percent > WARNING_PERCENT, "warning")
        .otherwise("info")
    )
    return missing_overview(missing).withColumn("level", level)


def issue_chart(issues: DataFrame) -> DataFrame:
    """``chart, label, issues``: counts by severity and the ten most frequent types."""
    severity = issues_by_severity(issues).select(
        F.lit("severity").alias("chart"), F.col("severity").alias("label"), "issues"
    )
    kinds = (
        issues_by_type(issues)
        .orderBy(F.desc("issues"), "issue_type")
        .limit(MAX_TYPES)
        .select(F.lit("type").alias("chart"), F.col("issue_type").alias("label"), "issues")
    )
    return severity.unionByName(kinds)


def _nothing(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def distribution_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, n, bins, min, max, mean, median, skew, skew_class`` per numeric column."""
    infos = numeric_columns(df, columns)
    if not infos:
        return _nothing(
            df,
            "column string, ordinal int, n long, bins int, min double, max double, mean double, "
            "median double, skew double, skew_class string",
        )
    stats = numeric_summary(df, infos)
    names = F.create_map(*[F.lit(x) for c in infos for x in (c.ordinal, c.name)])
    size = F.abs("skew")
    skew_class = (
        F.when(size > HIGH_SKEW, "high").when(size > MODERATE_SKEW, "moderate").otherwise("low")
    )
    bins = F.greatest(
        F.lit(MIN_BINS), F.least(F.lit(MAX_BINS), F.floor(F.col("n") / VALUES_PER_BIN))
    ).cast("int")
    return stats.select(
        names[F.col("key")].alias("column"),
        F.col("key").alias("ordinal"),
        "n",
        bins.alias("bins"),
        "min",
        "max",
        "mean",
        "median",
        "skew",
        skew_class.alias("skew_class"),
    )


def histogram(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, bin, lower, upper, cnt``: equal-width bins, the last one closed, empty ones kept.

    Range and count come from one aggregate row; the second pass carries at
    most one row per bin and task into the shuffle.
    """
    infos = numeric_columns(df, columns)
    if not infos:
        return _nothing(df, "column string, bin int, lower double, upper double, cnt long")
    aggs = []
    for c in infos:
        value, i = as_double(c), c.ordinal
        aggs += [f"count({value}) AS n{i}", f"min({value}) AS lo{i}", f"max({value}) AS hi{i}"]
    row = df.agg(*map(F.expr, aggs)).collect()[0]
    entries, bounds, bins = [], {}, []
    for c in infos:
        n, lo, hi = row[f"n{c.ordinal}"], row[f"lo{c.ordinal}"], row[f"hi{c.ordinal}"]
        if not n:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        k = max(MIN_BINS, min(MAX_BINS, n // VALUES_PER_BIN))
        edges = [lo + i * ((hi - lo) / k) for i in range(k)] + [hi]
        entries.append((c.ordinal, as_double(c)))
        bounds[c.ordinal] = double_array(edges)
        bins += [(c.ordinal, c.name, b + 1, edges[b], edges[b + 1]) for b in range(k)]
    all_bins = literal_frame(
        df.sparkSession, bins, "key int, column string, bin int, lower double, upper double"
    )
    if not entries:
        return all_bins.select("column", "bin", "lower", "upper", F.lit(0).cast("long").alias("cnt"))
    long = melt(df, entries, {"edges": bounds}).filter("value IS NOT NULL")
    placed = with_position(long, "value", "edges", MAX_BINS + 1, "pos")
    counts = placed.groupBy(
        "key", F.least(F.col("pos"), F.size("edges") - 1).alias("bin")
    ).agg(F.count(F.lit(1)).alias("cnt"))
    # At most MAX_BINS rows per column.
    return all_bins.join(F.broadcast(counts), ["key", "bin"], "left").select(
        "column", "bin", "lower", "upper", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt")
    )


def box_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Quartiles, fences and outlier counts per numeric column; no minimum row count."""
    infos = numeric_columns(df, columns)
    schema = (
        "column string, q1 double, median double, q3 double, iqr double, lower_bound double, "
        "upper_bound double, outlier_count long, outlier_percentage double"
    )
    if not infos:
        return _nothing(df, schema)
    entries = [(c.ordinal, as_double(c)) for c in infos]
    stats = order_statistics(df, entries, QUARTILES).toDF("key", "n", "q1", "median", "q3")
    by_key = {r["key"]: r for r in stats.collect()}  # one row per column
    bounds = {
        k: (r["q1"] - BOX_FENCE * (r["q3"] - r["q1"]), r["q3"] + BOX_FENCE * (r["q3"] - r["q1"]))
        for k, r in by_key.items()
    }
    shown = [c for c in infos if c.ordinal in by_key]
    if not shown:
        return _nothing(df, schema)
    counts = df.agg(
        *[
            F.expr(
                f"count_if({as_double(c)} < {literal(bounds[c.ordinal][0])} "
                f"OR {as_double(c)} > {literal(bounds[c.ordinal][1])}) AS out{c.ordinal}"
            )
            for c in shown
        ]
    )
    cells = []
    for c in shown:
        r, (lo, hi), out = by_key[c.ordinal], bounds[c.ordinal], F.col(f"out{c.ordinal}")
        cells.append(
            F.struct(
                F.lit(c.name).alias("column"),
                F.lit(r["q1"]).alias("q1"),
                F.lit(r["median"]).alias("median"),
                F.lit(r["q3"]).alias("q3"),
                F.lit(r["q3"] - r["q1"]).alias("iqr"),
                F.lit(lo).alias("lower_bound"),
                F.lit(hi).alias("upper_bound"),
                out.alias("outlier_count"),
                F.expr(percentage(f"out{c.ordinal}", str(r["n"]))).alias("outlier_percentage"),
            )
        )
    return counts.select(F.inline(F.array(*cells)))


def correlation_heatmap(df: DataFrame) -> DataFrame:
    """The correlation matrix of the numeric columns; empty with fewer than two."""
    return correlation_matrix(df)


def top_categories(df: DataFrame, columns: list[str] | None = None, limit: int = MAX_CATEGORIES) -> DataFrame:
    """``column, category, cnt, percentage, is_other``: the most frequent values per text column.

    With more than ``limit`` values, the top ``limit - 1`` and the rest as "Other".
    Texts are not shuffled, see :func:`plumbline.plans.heavy.top_values`.
    """
    infos = [c for c in describe_columns(df, columns) if c.family == "text"]
    if not infos:
        raise ValueError("the table has no such text column")
    ranked = top_values(df, infos, limit)
    shown = F.sum("cnt").over(Window.partitionBy("key"))
    # With all values shown there is no rest, else the last one joins it.
    kept = ranked.withColumn("shown_rows", shown).filter((F.col("shown_rows") == F.col("n")) | (F.col("place") < limit))
    category = F.struct(F.col("value").alias("category"), "cnt", F.lit(False).alias("is_other"))
    rolled = kept.groupBy("key", "n").agg(
        F.collect_list(category).alias("rows"), F.sum("cnt").alias("shown")
    )
    rest = F.struct(
        F.lit("Other").alias("category"),
        (F.col("n") - F.col("shown")).alias("cnt"),
        F.lit(True).alias("is_other"),
    )
    rows = F.when(F.col("n") > F.col("shown"), F.array_append("rows", rest)).otherwise(F.col("rows"))
    names = F.create_map(*[F.lit(x) for c in infos for x in (c.ordinal, c.name)])
    return (
        rolled.select(names[F.col("key")].alias("column"), "n", F.inline(rows))
        .select("column", "category", "cnt", F.expr(percentage("cnt", "n")).alias("percentage"), "is_other")
    )
