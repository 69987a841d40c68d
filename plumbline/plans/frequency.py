"""Distinct counts, value counts and the text summary, each from one shuffle.

Every table here is grouped by (column, value) with a map-side combine, so a
value that fills a third of the rows reaches the shuffle as one row per task.
Long text travels as the SHA-256 of the whole value, not as the text itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import FLOATING, INTEGRAL, ColumnInfo, clean, ident, literal, text_values
from plumbline.functions.stats import entropy_bits
from plumbline.functions.text import LONG_BYTES, compact, is_digested, normalise
from plumbline.plans.longform import melt


def comparable(info: ColumnInfo) -> tuple[str, str] | None:
    """A type that compares values exactly, and SQL text of the column in it."""
    col = clean(info)
    if isinstance(info.type, INTEGRAL):
        return "bigint", f"cast({col} AS bigint)"
    if isinstance(info.type, FLOATING):
        return "double", f"cast({col} AS double)"
    if isinstance(info.type, T.BooleanType):
        return "bigint", f"cast(cast({col} AS int) AS bigint)"
    if isinstance(info.type, T.DecimalType):
        return "string", f"cast({col} AS string)"
    if isinstance(info.type, T.TimestampType):
        return "timestamp", col
    if info.family == "datetime":
        return "timestamp_ntz", f"cast({col} AS timestamp_ntz)"
    if info.family == "text":
        return "string", compact(f"cast({col} AS string)")
    return None


def distinct_counts(df: DataFrame, infos: Sequence[ColumnInfo]) -> DataFrame:
    """``key, unique_count`` for each column with a present value, exact."""
    families: dict[str, list[tuple[int, str]]] = {}
    for info in infos:
        form = comparable(info)
        if form:
            families.setdefault(form[0], []).append((info.ordinal, form[1]))
    parts = [
        melt(df, entries)
        .filter("value IS NOT NULL")
        .groupBy("key", "value")
        .agg(F.expr("count(1) AS cnt"))  # a count keeps the fast aggregation map in use
        .groupBy("key")
        .agg(F.expr("count(1) AS unique_count"))
        for entries in families.values()
    ]
    if not parts:
        return df.sparkSession.createDataFrame([], "key int, unique_count long")
    return reduce(DataFrame.unionAll, parts)


def value_counts(df: DataFrame, infos: Sequence[ColumnInfo]) -> DataFrame:
    """``key, value, cnt``: every present value of same-typed columns with its count."""
    return (
        melt(df, [(i.ordinal, clean(i)) for i in infos])
        .filter("value IS NOT NULL")
        .groupBy("key", "value")
        .agg(F.expr("count(1) AS cnt"))
    )


def _spellings(df: DataFrame, infos: Sequence[ColumnInfo], excluded: dict[str, list]) -> DataFrame:
    """``key, cell, head, norm, skipped, cnt`` per distinct value."""
    skips = [
        f"(key = {i.ordinal} AND value IN ({', '.join(map(literal, text_values(excluded[i.name])))}))"
        for i in infos
        if text_values(excluded.get(i.name) or [])
    ]
    return (
        melt(df, [(i.ordinal, f"cast({clean(i)} AS string)") for i in infos])
        .filter("value IS NOT NULL")
        .selectExpr(
            "key",
            f"{' OR '.join(skips) or 'false'} AS skipped",
            f"{compact('value')} AS cell",
            f"CASE WHEN {is_digested('value')} THEN substring(value, 1, {LONG_BYTES}) END AS head",
            f"CASE WHEN {is_digested('value')} THEN {compact(normalise('value'))} END AS long_norm",
        )
        .groupBy("key", "skipped", "cell", "head", "long_norm")
        .agg(F.expr("count(1) AS cnt"))
        .selectExpr(
            "key", "skipped", "cell", "head", "cnt",
            f"coalesce(long_norm, {compact(normalise('cell'))}) AS norm",
        )
    )


def text_summary(
    df: DataFrame, infos: Sequence[ColumnInfo], excluded: dict[str, list] | None = None
) -> DataFrame:
    """Per text column: count, distinct, entropy, mode and spelling groups.

    ``spelling_groups`` counts the normalised values, ``inconsistent_rows`` the
    rows whose normalised value is written in more than one way. A long mode is
    known by its first characters only, see :func:`long_modes`.
    """
    # Highest count first, then the smallest value. `head` orders long values;
    # which of those sharing a head is the mode is settled in `long_modes`.
    rank = (
        "named_struct('neg', -cnt, 'head', coalesce(head, cell), 'long', head IS NOT NULL, "
        "'cell', cell)"
    )
    by_norm = (
        "sum(cnt) AS rows",
        "count(1) AS values",
        "sum(cnt * log2(cnt)) AS clog",
        f"min({rank}) AS mode",
        "count_if(NOT skipped) AS spellings",
        "sum(CASE WHEN skipped THEN 0 ELSE cnt END) AS kept_rows",
    )
    by_column = (
        "sum(rows) AS n",
        "sum(values) AS unique_count",
        "sum(clog) AS clog",
        "min(mode) AS mode",
        "count_if(spellings > 0) AS spelling_groups",
        "count_if(spellings > 1) AS inconsistent_groups",
        "sum(CASE WHEN spellings > 1 THEN kept_rows ELSE 0 END) AS inconsistent_rows",
    )
    return (
        _spellings(df, infos, excluded or {})
        .groupBy("key", "norm")
        .agg(*map(F.expr, by_norm))
        .groupBy("key")
        .agg(*map(F.expr, by_column))
        .selectExpr(
            "key", "n", "unique_count", f"{entropy_bits('n', 'clog')} AS entropy",
            "-mode.neg AS most_common_count", "mode.long AS mode_long",
            "mode.head AS most_common", "spelling_groups", "inconsistent_groups",
            "inconsistent_rows",
        )
    )


def long_modes(
    df: DataFrame, infos: Sequence[ColumnInfo], heads: dict[int, tuple[str, int]]
) -> DataFrame:
    """``key, long_value``: the mode of each column in ``heads`` (first characters, count).

    Only rows that begin like the mode are grouped by their full text.
    """
    parts = []
    for info in infos:
        if info.ordinal in heads:
            head, count = heads[info.ordinal]
            col = ident(info.name)
            begins = f"substring({col}, 1, {LONG_BYTES}) = {literal(head)}"
            parts.append(
                df.filter(f"{is_digested(col)} AND {begins}")
                .groupBy(F.expr(f"{col} AS value"))
                .agg(F.expr("count(1) AS cnt"))
                .filter(f"cnt = {count}")
                .agg(F.expr(f"{info.ordinal} AS key"), F.expr("min(value) AS long_value"))
            )
    return reduce(DataFrame.unionAll, parts)


def spelling_examples(
    df: DataFrame,
    infos: Sequence[ColumnInfo],
    excluded: dict[str, list] | None = None,
    groups: int = 5,
    spellings: int | None = None,
) -> DataFrame:
    """``key, examples``: the biggest spelling groups of each column, as text.

    All spellings of a shown group are listed, or the most frequent ``spellings``
    of them, which are then cut down in each task before the shuffle.
    """
    cells = _spellings(df, infos, excluded or {}).filter("NOT skipped")
    top = (
        cells.groupBy("key", "norm")
        .agg(F.expr("count(1) AS spellings"), F.expr("sum(cnt) AS rows"))
        .filter("spellings > 1")
        .selectExpr(
            "key", "norm", "row_number() OVER (PARTITION BY key ORDER BY rows DESC, norm) AS place"
        )
        .filter(f"place <= {groups}")
    )
    listed = (
        cells.join(F.broadcast(top), ["key", "norm"])  # at most `groups` rows per column
        .selectExpr(
            "key", "norm", "place", "coalesce(concat(head, '...'), cell) AS text",
            "row_number() OVER (PARTITION BY key, norm ORDER BY cnt DESC, cell) AS seat",
        )
        .filter("true" if spellings is None else f"seat <= {spellings}")
        .groupBy("key", "norm", "place")
        .agg(F.expr("sort_array(collect_list(struct(seat, text))) AS texts"))
        .selectExpr("key", "place", "array_join(transform(texts, t -> t.text), ' | ') AS example")
    )
    return listed.groupBy("key").agg(
        F.expr("transform(sort_array(collect_list(struct(place, example))), e -> e.example) AS examples")
    )
