"""Rows that stand in a table more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import FLOATING, ColumnInfo, describe_columns, ident

COPIES = "copies"
_DIGEST, _CHECK = "__digest", "__check"


def _marked(info: ColumnInfo) -> str:
    """SQL text of a value with its length before it, so neighbours cannot run together; N is a NULL."""
    name = ident(info.name)
    if isinstance(info.type, FLOATING):
        value = f"CASE WHEN {name} = 0 THEN '0.0' ELSE cast({name} AS string) END"
    elif info.dtype == "binary":
        value = f"hex({name})"
    elif info.family == "other":
        value = f"CASE WHEN {name} IS NOT NULL THEN to_json(struct({name}), map('ignoreNullFields', 'false')) END"
    else:
        value = f"cast({name} AS string)"
    return f"coalesce(concat(octet_length({value}), ':', {value}), 'N')"


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[Column, Column]:
    """A 128-bit digest of the named columns, and another hash of them to verify it by.

    Equal rows have equal digests, NULL being equal to NULL and 0.0 to -0.0.
    """
    infos = describe_columns(df, None if columns is None else list(columns))
    row = f"concat({', '.join(_marked(i) for i in infos)})"
    return F.expr(f"unhex(md5({row}))"), F.expr(f"xxhash64({row})")


def _digested(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    digest, check = row_digest(df, columns)
    return df.withColumns({_DIGEST: digest, _CHECK: check})


def _groups(df: DataFrame) -> DataFrame:
    """Digest and number of the rows that stand there more than once, counted in each task before the shuffle."""
    counted = df.groupBy(_DIGEST, _CHECK).agg(F.count(F.lit(1)).alias(COPIES))
    return counted.filter(F.col(COPIES) > 1)


def duplicate_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``rows``, ``distinct_rows``, ``duplicate_groups``, ``duplicate_rows`` and ``largest_group``.

    ``duplicate_rows`` counts what goes if one row of each group stays. The digests
    and their counts are shuffled, never the rows.
    """
    counted = _digested(df, columns).groupBy(_DIGEST, _CHECK).agg(F.count(F.lit(1)).alias(COPIES))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return counted.agg(
        zero(F.sum(COPIES)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.count_if(F.col(COPIES) > 1).alias("duplicate_groups"),
        zero(F.sum(F.col(COPIES) - 1)).alias("duplicate_rows"),
        zero(F.max(COPIES)).alias("largest_group"),
    )


def duplicate_members(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All rows that equal another one in ``columns`` (default: all), with their number of ``copies``.

    The groups are found from digests; the rows then meet the groups, of which
    those with a thousandth of all rows or more, at most a thousand, are
    broadcast, so that no task gets a whole large group.
    """
    if COPIES in df.columns:
        raise ValueError(f"the table has a column {COPIES!r} already")
    rows = _digested(df, columns)
    groups = _groups(rows)
    total = df.count()
    frequent = F.col(COPIES) >= max(1000, total / 1000)
    hot = groups.filter(frequent).select(F.col(_DIGEST).alias("__d"), F.col(_CHECK).alias("__k"), F.col(COPIES).alias("__hot"))
    met = rows.join(F.broadcast(hot), (F.col(_DIGEST) == F.col("__d")) & (F.col(_CHECK) == F.col("__k")), "left")
    large = met.filter("__hot IS NOT NULL").select(*map(ident, df.columns), F.col("__hot").alias(COPIES))
    rest = met.filter("__hot IS NULL").join(groups.filter(~frequent), [_DIGEST, _CHECK])
    return large.unionByName(rest.select(*map(ident, df.columns), COPIES))


def duplicate_groups(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per group of equal rows: the values of ``columns`` and the number of ``copies``.

    Only rows of such groups are shuffled with their values.
    """
    names = list(columns) if columns is not None else df.columns
    members = duplicate_members(df, columns).select(*map(ident, names), COPIES)
    digest, check = row_digest(members, names)
    keyed = members.withColumns({_DIGEST: digest, _CHECK: check})
    return keyed.dropDuplicates([_DIGEST, _CHECK]).drop(_DIGEST, _CHECK)
