"""Profiles as states that can be stored per part of a table and merged.

A state is one row per column and part (a day, a partition, a batch): counts,
central moments, least and greatest value, and three mergeable sketches, a KLL
sketch of the quantiles, a HyperLogLog sketch of the distinct values, and a
frequent-items sketch of the texts. Merging adds counts, moves the moments to the
common mean and adds them there, and unites the sketches; it never reads the rows
again. Counts, moments and ranges of the merged profile are those of all rows;
distinct counts, quantiles and most common texts are estimates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import INTEGRAL, ColumnInfo, as_double, clean, describe_columns, ident, literal
from plumbline.functions.stats import percentage
from plumbline.functions.text import compact
from plumbline.plans.longform import BATCH

#: Size of the quantile sketch: rank errors stay below about 0.2 %.
KLL_K = 2000
#: Registers of the distinct sketch, as a power of two: a standard error below 0.6 %.
HLL_LG = 15
#: Items that the frequent-items sketch tracks.
FREQUENT = 256

SUMS = ("total", "n", "zeros")
CENTRAL = ("m2", "m3", "m4")
KEY = ("column", "ordinal", "dtype", "family")


def value_hash(info: ColumnInfo) -> str:
    """SQL text of a 64-bit hash of the present value in its own type; NULL where it is missing."""
    value = clean(info)
    if info.family == "other":
        value = f"CASE WHEN {ident(info.name)} IS NOT NULL THEN to_json(struct({ident(info.name)})) END"
    return f"CASE WHEN {value} IS NOT NULL THEN xxhash64({value}) END"


def _cell(info: ColumnInfo) -> str:
    """SQL text of a column's struct in the long form: each family fills its own fields."""
    name, family = ident(info.name), info.family
    number = as_double(info) if family in ("numeric", "boolean") else "cast(NULL AS double)"
    whole = f"cast({name} AS bigint)" if isinstance(info.type, INTEGRAL) else "cast(NULL AS bigint)"
    text = compact(f"cast({name} AS string)") if family == "text" else "cast(NULL AS string)"
    date = f"cast({name} AS timestamp_ntz)" if family == "datetime" else "cast(NULL AS timestamp_ntz)"
    return f"named_struct('h', {value_hash(info)}, 'v', {number}, 'l', {whole}, 't', {text}, 'd', {date})"


def _long(df: DataFrame, infos: Sequence[ColumnInfo], by: Sequence[str]) -> DataFrame:
    parts = []
    for at in range(0, len(infos), BATCH):
        some = infos[at : at + BATCH]
        cells = ", ".join(_cell(i) for i in some)
        keys = ", ".join(str(i.ordinal) for i in some)
        long = df.selectExpr(*map(ident, by), f"posexplode(array({cells})) AS (__pos, __c)")
        parts.append(long.selectExpr(*map(ident, by), f"get(array({keys}), __pos) AS ordinal", "__c.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _named(df: DataFrame, infos: Sequence[ColumnInfo]) -> DataFrame:
    """``df`` with the name, type and family that belong to its ``ordinal``."""
    names = ", ".join(f"{c.ordinal}, struct({literal(c.name)}, {literal(c.dtype)}, {literal(c.family)})" for c in infos)
    info = df.selectExpr("*", f"map({names})[ordinal] AS __info")
    return info.selectExpr("*", "__info.col1 AS column", "__info.col2 AS dtype", "__info.col3 AS family").drop("__info")


def profile_states(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A state per column and group of ``by``; one pass that shuffles a row per column, group and task.

    NaN is missing, like NULL. A table without rows or columns has no states.
    """
    infos = [c for c in describe_columns(df) if c.name not in by]
    if not infos:
        raise ValueError("no column is left to profile")
    grouped = _long(df, infos, by).groupBy(*map(ident, by), "ordinal").agg(
        F.expr("count(1) AS total"),
        F.expr("count(h) AS n"),
        F.expr("count_if(v = 0) AS zeros"),
        F.expr("avg(v) AS mean"),
        F.expr("var_pop(v) * count(v) AS m2"),
        F.expr("skewness(v) AS g1"),
        F.expr("kurtosis(v) AS g2"),
        F.expr("min(v) AS lo"),
        F.expr("max(v) AS hi"),
        F.expr("min(l) AS lo_whole"),
        F.expr("max(l) AS hi_whole"),
        F.expr("min(d) AS lo_date"),
        F.expr("max(d) AS hi_date"),
        F.expr(f"kll_sketch_agg_double(v, {KLL_K}) AS quantiles"),
        F.expr(f"hll_sketch_agg(h, {HLL_LG}) AS distinct"),
        F.expr(f"approx_top_k_accumulate(t, {FREQUENT}) AS frequent"),
    )
    central = {
        "m2": "coalesce(m2, 0D)",
        "m3": "coalesce(nanvl(g1, NULL) * pow(m2, 1.5D) / sqrt(n), 0D)",
        "m4": "coalesce((nanvl(g2, NULL) + 3) * m2 * m2 / n, 0D)",
    }
    kept = [c for c in grouped.columns if c not in ("m2", "g1", "g2")]
    found = grouped.selectExpr(*map(ident, kept), *[f"{x} AS {n}" for n, x in central.items()])
    rest = [c for c in found.columns if c not in (*by, "ordinal")]
    return _named(found, infos).select(*map(ident, by), *KEY, *rest)


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The states of the unions of parts: one per column and group of ``by``.

    States of columns that have another type in some parts stay apart by ``dtype``.
    """
    names = [*by, *KEY]
    keys = [*map(ident, by), *KEY]
    means = states.groupBy(*keys).agg(F.expr("try_divide(sum(n * mean), sum(CASE WHEN mean IS NOT NULL THEN n END)) AS __mean"))
    means = means.toDF(*[f"__k{i}" for i in range(len(names))], "__mean")
    same = F.lit(True)
    for i, name in enumerate(names):
        same = same & F.col(ident(name)).eqNullSafe(F.col(f"__k{i}"))
    moved = states.join(means, same)
    moved = moved.selectExpr("*", "coalesce(mean - __mean, 0D) AS __d")
    return moved.groupBy(*keys).agg(
        *[F.expr(f"sum({c}) AS {c}") for c in SUMS],
        F.expr("first(__mean) AS mean"),
        F.expr("sum(m2 + n * __d * __d) AS m2"),
        F.expr("sum(m3 + 3 * __d * m2 + n * __d * __d * __d) AS m3"),
        F.expr("sum(m4 + 4 * __d * m3 + 6 * __d * __d * m2 + n * __d * __d * __d * __d) AS m4"),
        *[F.expr(f"min(lo{x}) AS lo{x}") for x in ("", "_whole", "_date")],
        *[F.expr(f"max(hi{x}) AS hi{x}") for x in ("", "_whole", "_date")],
        F.expr("kll_merge_agg_double(quantiles) AS quantiles"),
        F.expr("hll_union_agg(distinct) AS distinct"),
        F.expr(f"approx_top_k_combine(frequent, {FREQUENT}) AS frequent"),
    ).select(*map(ident, by), *_STATE)


_STATE = (
    *KEY, *SUMS, "mean", "lo", "hi", "lo_whole", "hi_whole", "lo_date", "hi_date", "quantiles", "distinct", "frequent", *CENTRAL,
)


def profile_from_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The profile of all rows behind ``states``, per group of ``by``.

    ``unique_count``, ``median``, ``q1``, ``q3`` and ``most_common`` with its count
    are estimates; ``min_whole`` and ``max_whole`` are the exact range of an
    integer column, which a double cannot always hold.
    """
    merged = merge_states(states, by)
    number = "family IN ('numeric', 'boolean') AND n > 0"
    constant = "m2 < 1e-14D"
    quantile = lambda p: f"CASE WHEN {number} THEN kll_sketch_get_quantile_double(quantiles, {p}D) END"
    top = "CASE WHEN family = 'text' AND n > 0 THEN approx_top_k_estimate(frequent, 1)[0] END"
    found = merged.selectExpr("*", "cast(n AS double) AS __c", f"{top} AS __top")
    return found.selectExpr(
        *map(ident, by), *KEY,
        "total AS total_count", "total - n AS missing_count", f"{percentage('(total - n)', 'total')} AS missing_percentage",
        "CASE WHEN family != 'other' THEN hll_sketch_estimate(distinct) END AS unique_count",
        "mean", f"CASE WHEN {number} AND n >= 2 THEN sqrt(m2 / (n - 1)) END AS std", "lo AS min", "hi AS max",
        "lo_whole AS min_whole", "hi_whole AS max_whole",
        f"{quantile(0.5)} AS median", f"{quantile(0.25)} AS q1", f"{quantile(0.75)} AS q3",
        f"CASE WHEN NOT ({number}) OR n < 3 THEN NULL WHEN {constant} THEN 0D ELSE "
        "sqrt(__c * (__c - 1)) / (__c - 2) * (m3 / __c) / pow(m2 / __c, 1.5D) END AS skew",
        f"CASE WHEN NOT ({number}) OR n < 4 THEN NULL WHEN {constant} THEN 0D ELSE "
        "(__c - 1) / ((__c - 2) * (__c - 3)) * ((__c + 1) * (m4 * __c / (m2 * m2) - 3) + 6) END AS kurtosis",
        f"CASE WHEN {number} THEN zeros END AS zero_count",
        "__top.item AS most_common", "__top.count AS most_common_count",
        "lo_date AS min_date", "hi_date AS max_date", "timestampdiff(DAY, lo_date, hi_date) AS date_range_days",
    )
