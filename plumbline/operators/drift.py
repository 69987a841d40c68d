"""Drift of a current table against a reference table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import (
    ColumnInfo,
    as_double,
    clean,
    describe_columns,
    literal,
    schema_frame,
)
from plumbline.functions.stats import drift_status, ks_p_value, relative_change
from plumbline.plans.ecdf import (
    Totals,
    binned_counts,
    category_psi,
    ks_distances,
    psi_of,
)
from plumbline.plans.frequency import comparable
from plumbline.plans.orderstats import quantiles

DECILES = tuple(i / 10 for i in range(11))

Pair = tuple[ColumnInfo, ColumnInfo]


def common_columns(ref: DataFrame, cur: DataFrame, columns: list[str] | None = None) -> list[Pair]:
    """Columns of both tables, in the order of the reference."""
    right = {c.name: c for c in describe_columns(cur)}
    return [(c, right[c.name]) for c in describe_columns(ref, columns) if c.name in right]


def _is_number(pair: Pair) -> bool:
    return all(c.family in ("numeric", "boolean") for c in pair)


def _is_category(pair: Pair) -> bool:
    return not _is_number(pair) and all(c.family != "other" for c in pair)


def present_totals(ref: DataFrame, cur: DataFrame, pairs: list[Pair]) -> Totals:
    """Present values of each column on both sides: one aggregate row per table."""
    if not pairs:
        return {}
    left = ref.agg(*[F.expr(f"count({clean(a)}) AS n{a.ordinal}") for a, _ in pairs]).collect()[0]
    right = cur.agg(*[F.expr(f"count({clean(b)}) AS n{a.ordinal}") for a, b in pairs]).collect()[0]
    return {a.ordinal: (left[f"n{a.ordinal}"], right[f"n{a.ordinal}"]) for a, _ in pairs}


def decile_edges(ref: DataFrame, pairs: list[Pair], totals: Totals) -> dict[int, list[float]]:
    """Distinct reference deciles; a constant column gets one bin around its value.

    A boolean column is cut between false and true.
    """
    pairs = [p for p in pairs if _is_number(p) and min(totals[p[0].ordinal]) > 0]
    edges = {a.ordinal: [0.0, 0.5, 1.0] for a, _ in pairs if a.family == "boolean"}
    numbers = [(a.ordinal, as_double(a)) for a, _ in pairs if a.family == "numeric"]
    if numbers:
        for key, values in quantiles(ref, numbers, DECILES).items():
            distinct = sorted(set(values))
            edges[key] = distinct if len(distinct) > 1 else [distinct[0] - 1, distinct[0] + 1]
    return edges


def _numeric_frame(
    ref: DataFrame,
    cur: DataFrame,
    pairs: list[Pair],
    totals: Totals,
    edges: dict[int, list[float]],
) -> DataFrame | None:
    """``key, psi, ref_mean, cur_mean`` of the numeric and boolean columns."""
    usable = [p for p in pairs if _is_number(p) and p[0].ordinal in edges]
    if not usable:
        return None
    entries = [(a.ordinal, as_double(a), as_double(b)) for a, b in usable]
    bins = binned_counts(ref, cur, entries, edges)
    return psi_of(bins, totals, inside="bin > 0", means=True)


def _category_frame(
    ref: DataFrame, cur: DataFrame, pairs: list[Pair], totals: Totals
) -> DataFrame | None:
    """``key, psi`` over exact values; columns of one type are counted together."""
    by_type: dict[str, list] = {}
    for a, b in pairs:
        if _is_category((a, b)) and min(totals[a.ordinal]) > 0:
            (kind, left), (other, right) = comparable(a), comparable(b)
            if kind != other:
                kind = "string"
                left, right = f"cast({left} AS string)", f"cast({right} AS string)"
            by_type.setdefault(kind, []).append((a.ordinal, left, right))
    parts = [category_psi(ref, cur, entries, totals) for entries in by_type.values()]
    return reduce(DataFrame.unionAll, parts) if parts else None


def _ks_frame(
    ref: DataFrame,
    cur: DataFrame,
    pairs: list[Pair],
    totals: Totals,
) -> DataFrame | None:
    usable = [p for p in pairs if _is_number(p) and min(totals[p[0].ordinal]) > 0]
    if not usable:
        return None
    entries = [(a.ordinal, as_double(a), as_double(b)) for a, b in usable]
    return ks_distances(ref, cur, entries, totals).selectExpr(
        "key", "d AS ks_statistic", f"{ks_p_value('d', 'n_ref', 'n_cur')} AS ks_p_value"
    )


def _by_column(ref: DataFrame, pairs: list[Pair], parts: list[DataFrame | None]) -> DataFrame:
    """Attach per-key frames to the column list; every side has one row per column."""
    out = schema_frame(ref.sparkSession, [a for a, _ in pairs])
    for part in parts:
        if part is not None:
            out = out.join(F.broadcast(part.withColumnRenamed("key", "ordinal")), "ordinal", "left")
    return out


def mean_changes(ref: DataFrame, cur: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, ref_mean, curr_mean, pct_change`` of the numeric columns both tables share."""
    pairs = [p for p in common_columns(ref, cur, columns) if _is_number(p)]
    if not pairs:
        return ref.sparkSession.createDataFrame(
            [], "column string, ref_mean double, curr_mean double, pct_change double"
        )

    def means(df: DataFrame, side: int, name: str) -> DataFrame:
        row = df.agg(*[F.expr(f"avg({as_double(p[side])}) AS m{p[0].ordinal}") for p in pairs])
        cells = ", ".join(
            f"named_struct('column', {literal(a.name)}, '{name}', m{a.ordinal})" for a, _ in pairs
        )
        return row.selectExpr(f"inline(array({cells}))").filter(f"{name} IS NOT NULL")

    joined = means(ref, 0, "ref_mean").join(F.broadcast(means(cur, 1, "curr_mean")), "column")
    change = relative_change("ref_mean", "curr_mean")
    return joined.selectExpr("column", "ref_mean", "curr_mean", f"{change} AS pct_change")


def compare_profiles(ref_profile: DataFrame, cur_profile: DataFrame) -> DataFrame:
    """The same comparison from two profiles, without reading the tables again."""
    left = ref_profile.filter("mean IS NOT NULL").selectExpr("column", "mean AS ref_mean")
    right = cur_profile.filter("mean IS NOT NULL").selectExpr("column", "mean AS curr_mean")
    change = relative_change("ref_mean", "curr_mean")
    return left.join(F.broadcast(right), "column").selectExpr("*", f"{change} AS pct_change")


def population_stability(
    ref: DataFrame, cur: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """``column, psi, drift_status`` of the columns both tables share."""
    pairs = common_columns(ref, cur, columns)
    totals = present_totals(ref, cur, pairs)
    edges = decile_edges(ref, pairs, totals)
    numbers = _numeric_frame(ref, cur, pairs, totals, edges)
    categories = _category_frame(ref, cur, pairs, totals)
    found = [f.select("key", "psi") for f in (numbers, categories) if f is not None]
    part = reduce(DataFrame.unionByName, found) if found else None
    out = _by_column(ref, pairs, [part])
    psi = "coalesce(psi, 0D)" if found else "0D"
    return out.selectExpr("column", f"{psi} AS psi", f"{drift_status(psi)} AS drift_status")


def kolmogorov_smirnov(
    ref: DataFrame, cur: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """``column, ks_statistic, ks_p_value``; 0 and 1 where there is nothing to compare."""
    pairs = common_columns(ref, cur, columns)
    totals = present_totals(ref, cur, pairs)
    part = _ks_frame(ref, cur, pairs, totals)
    out = _by_column(ref, pairs, [part])
    d, p = ("ks_statistic", "ks_p_value") if part is not None else ("NULL", "NULL")
    return out.selectExpr(
        "column", f"coalesce({d}, 0D) AS ks_statistic", f"coalesce({p}, 1D) AS ks_p_value"
    )


def drift_table(ref: DataFrame, cur: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """PSI with its status, mean change and KS test per shared column, by column name.

    ``pct_change`` and the KS columns are NULL where they do not apply.
    """
    pairs = common_columns(ref, cur, columns)
    totals = present_totals(ref, cur, pairs)
    edges = decile_edges(ref, pairs, totals)
    numbers = _numeric_frame(ref, cur, pairs, totals, edges)
    categories = _category_frame(ref, cur, pairs, totals)
    found = [f for f in (numbers, categories) if f is not None]
    part = (
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None
    )
    out = _by_column(ref, pairs, [part, _ks_frame(ref, cur, pairs, totals)])
    have = set(out.columns)
    psi, ref_mean, cur_mean, d, p = (
        c if c in have else "cast(NULL AS double)"
        for c in ("psi", "ref_mean", "cur_mean", "ks_statistic", "ks_p_value")
    )
    psi = f"coalesce({psi}, 0D)"
    keys = ", ".join(["-1", *[str(a.ordinal) for a, b in pairs if _is_number((a, b))]])
    numeric = f"ordinal IN ({keys})"
    return out.selectExpr(
        "column",
        "dtype",
        f"{psi} AS psi",
        f"{drift_status(psi)} AS drift_status",
        f"{relative_change(ref_mean, cur_mean)} AS pct_change",
        f"CASE WHEN {numeric} THEN coalesce({d}, 0D) END AS ks_statistic",
        f"CASE WHEN {numeric} THEN coalesce({p}, 1D) END AS ks_p_value",
    ).orderBy("column")
