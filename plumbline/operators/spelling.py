"""One spelling for values that differ only in case and surrounding white space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import ident, require
from plumbline.functions.text import compact, normalise

#: A value with this share of all rows is frequent; there are at most its inverse of them.
FREQUENT_SHARE = 1 / 1000
#: Rows of a mapping that may be broadcast (some 100 bytes each).
BROADCAST_ROWS = 200_000


def spelling_map(df: DataFrame, column: str) -> DataFrame:
    """``cell, canonical``: each value that is to be rewritten and its group's most frequent spelling.

    Of spellings that are equally frequent the smallest stays. ``cell`` is the
    value, or the digest of a long one (see ``compact``); groups are counted by
    cells, and only long spellings that stay are read back from the table.
    """
    if require(df, column).family != "text":
        raise ValueError(f"column {column!r} is not text")
    value = f"cast({ident(column)} AS string)"
    counts = (
        df.filter(f"{ident(column)} IS NOT NULL")
        .selectExpr(f"{compact(value)} AS cell", f"{compact(normalise(value))} AS norm", f"substring({value}, 1, 128) AS head")
        .groupBy("norm", "cell", "head")
        .agg(F.expr("count(1) AS cnt"))
    )
    best = (
        counts.groupBy("norm")
        .agg(F.expr("min(named_struct('neg', -cnt, 'head', head, 'cell', cell)).cell AS kept"), F.expr("count(1) AS spellings"))
        .filter("spellings > 1")
    )
    changed = counts.join(best, "norm").filter("cell != kept").select("cell", "kept", "cnt")
    long = F.col("kept").startswith("sha256:")
    texts = changed.filter(long).select("kept").distinct()
    full = (
        df.selectExpr(f"{compact(value)} AS kept", f"{value} AS canonical")
        .join(texts, "kept", "left_semi")
        .dropDuplicates(["kept"])
    )
    short = changed.filter(~long).selectExpr("cell", "kept AS canonical", "cnt")
    return short.unionByName(changed.filter(long).join(full, "kept").select("cell", "canonical", "cnt"))


def canonical_spelling(df: DataFrame, columns: Sequence[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with every value of ``columns`` in its group's most frequent spelling.

    The mapping has a row per value that changes, so it may be as large as the
    data: it is counted, and broadcast up to ``broadcast_rows``. Beyond that only
    the frequent values meet it in a broadcast (a thousandth of the rows each, so
    a thousand at most, changed or not), and the others are joined by value, so no
    task gets a whole frequent value. Missing values stay missing.
    """
    out, rows = df, None
    for column in columns:
        # Columns do not depend on each other; a row per changed value is kept.
        mapping = spelling_map(df, column).persist()
        if mapping.count() <= broadcast_rows:
            cell = compact(f"cast({ident(column)} AS string)")
            known = F.broadcast(mapping.selectExpr("cell AS __cell", "canonical AS __to"))
            out = _rewritten(out.withColumn("__key", F.expr(cell)).join(known, F.expr("__key = __cell"), "left"), column, df)
        else:
            rows = df.count() if rows is None else rows
            out = _rewritten(_joined_by_value(out, df, column, mapping, rows), column, df)
    return out


def _rewritten(joined: DataFrame, column: str, like: DataFrame) -> DataFrame:
    new = F.expr(f"CASE WHEN {ident(column)} IS NOT NULL THEN coalesce(__to, cast({ident(column)} AS string)) END")
    return joined.withColumn(column, new).select(*map(ident, like.columns))


def _joined_by_value(out: DataFrame, df: DataFrame, column: str, mapping: DataFrame, rows: int) -> DataFrame:
    """``out`` with ``__to``, frequent values apart from the others."""
    cell = compact(f"cast({ident(column)} AS string)")
    least = max(1000, rows * FREQUENT_SHARE)
    frequent = (
        df.filter(f"{ident(column)} IS NOT NULL").selectExpr(f"{cell} AS __hot").groupBy("__hot").agg(F.expr("count(1) AS __n"))
        .filter(F.col("__n") >= least).select("__hot")
    )
    named = mapping.filter(F.col("cnt") >= least).selectExpr("cell AS __hot", "canonical AS __to")
    known = frequent.join(F.broadcast(named), "__hot", "left")  # both at most 1 / FREQUENT_SHARE rows
    keyed = out.withColumn("__key", F.expr(cell)).join(F.broadcast(known), F.expr("__key = __hot"), "left")
    settled = keyed.filter("__hot IS NOT NULL OR __key IS NULL")
    rare = mapping.filter(F.col("cnt") < least).selectExpr("cell AS __key", "canonical AS __rare")
    rest = keyed.filter("__hot IS NULL AND __key IS NOT NULL").drop("__to").join(rare, "__key", "left")
    return settled.unionByName(rest.withColumnRenamed("__rare", "__to"))
