"""The most frequent values of text columns, exact, without shuffling the texts.

A mergeable sketch of frequent items proposes values by their hash and bounds the
count of every value it does not propose. The proposed values are then counted
exactly; if the last one that is wanted is above the bound, nothing else can be
among them. Columns without such values, texts that hardly repeat for one, are
counted by value or digest, and only the winners are read back in full.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import ColumnInfo, clean
from plumbline.functions.text import LONG_BYTES, compact, is_digested
from plumbline.plans.longform import melt

#: Items the sketch tracks; a value it does not hold has at most ``ERROR`` of a column's rows.
TRACKED = 8192
ERROR = 3.5 / TRACKED
#: Values proposed for each one that is wanted.
SPARE = 4


def _values(df: DataFrame, infos: Sequence[ColumnInfo]) -> DataFrame:
    return melt(df, [(i.ordinal, f"cast({clean(i)} AS string)") for i in infos]).filter("value IS NOT NULL")


def proposals(df: DataFrame, infos: Sequence[ColumnInfo], limit: int) -> dict[int, tuple[int, list[int], int]]:
    """Per column: its present rows, the hashes of likely values, and what any other value can have at most."""
    wanted = min(SPARE * limit, TRACKED)
    sketches = (
        _values(df, infos)
        .selectExpr("key", "xxhash64(value) AS h")
        .groupBy("key")
        .agg(F.expr("count(1) AS n"), F.expr(f"approx_top_k_accumulate(h, {TRACKED}) AS sketch"))
        .selectExpr("key", "n", f"approx_top_k_estimate(sketch, {wanted}) AS top")
    )
    out = {}
    for r in sketches.collect():
        items, counts = [t["item"] for t in r["top"]], [t["count"] for t in r["top"]]
        whole = len(items) < wanted and sum(counts) == r["n"]
        others = 0 if whole else max(int(ERROR * r["n"]) + 1, counts[-1] if len(items) == wanted else 0)
        out[r["key"]] = (r["n"], items, others)
    return out


def top_values(df: DataFrame, infos: Sequence[ColumnInfo], limit: int) -> DataFrame:
    """``key, value, cnt, n, place``: the ``limit`` most frequent values of each column and its present rows.

    Equal counts go by value. What reaches the driver is ``SPARE * limit`` numbers
    a column.
    """
    found = proposals(df, infos, limit)
    likely = [f"(key = {k} AND h IN ({', '.join(f'{h}L' for h in items)}))" for k, (_, items, _) in found.items() if items]
    settled: list[int] = []
    counts = None
    if likely:
        # At most SPARE * limit values a column are counted and kept.
        counts = (
            _values(df, infos).selectExpr("key", "value", "xxhash64(value) AS h").filter(" OR ".join(likely))
            .groupBy("key", "value").agg(F.expr("count(1) AS cnt")).persist()
        )
        own: dict[int, list[int]] = {}
        for r in counts.select("key", "cnt").collect():
            own.setdefault(r["key"], []).append(r["cnt"])
        for k, (_, _, others) in found.items():
            best = sorted(own.get(k, []), reverse=True)
            if others == 0 or (len(best) >= limit and best[limit - 1] > others):
                settled.append(k)
    parts = []
    if settled:
        parts.append(counts.filter(F.col("key").isin(settled)))
    unsettled = [i for i in infos if i.ordinal in found and i.ordinal not in settled]
    if unsettled:
        parts.append(_counted_by_digest(df, unsettled, limit))
    if not parts:
        return df.sparkSession.createDataFrame([], "key int, value string, cnt bigint, n bigint, place int")
    sizes = ", ".join(f"{k}, {n}L" for k, (n, _, _) in found.items())
    ranked = reduce(DataFrame.unionByName, parts).selectExpr(
        "*", f"map({sizes})[key] AS n", "row_number() OVER (PARTITION BY key ORDER BY cnt DESC, value) AS place"
    )
    return ranked.filter(f"place <= {limit}")


def sketched_modes(df: DataFrame, infos: Sequence[ColumnInfo]) -> DataFrame:
    """``key, most_common, most_common_count`` of the columns whose mode the sketch makes certain."""
    found = proposals(df, infos, SPARE)
    likely = [f"(key = {k} AND h IN ({', '.join(f'{h}L' for h in items)}))" for k, (_, items, _) in found.items() if items]
    others = ", ".join(f"{k}, {most}L" for k, (_, _, most) in found.items())
    if not likely:
        return df.sparkSession.createDataFrame([], "key int, most_common string, most_common_count bigint")
    counts = (
        _values(df, infos).selectExpr("key", "value", "xxhash64(value) AS h").filter(" OR ".join(likely))
        .groupBy("key", "value").agg(F.expr("count(1) AS cnt"))
    )
    best = counts.groupBy("key").agg(F.expr("min(struct(-cnt AS neg, value)) AS best"))
    return best.filter(f"-best.neg > map({others})[key]").selectExpr(
        "key", "best.value AS most_common", "-best.neg AS most_common_count"
    )


def _counted_by_digest(df: DataFrame, infos: Sequence[ColumnInfo], limit: int) -> DataFrame:
    """``key, value, cnt`` with the top values of columns whose values hardly repeat.

    Long values are counted by digest and ordered by their beginning; all that may
    be among the winners by count and beginning are read back and ordered whole.
    """
    cells = (
        _values(df, infos)
        .selectExpr("key", f"{compact('value')} AS cell", f"CASE WHEN {is_digested('value')} THEN substring(value, 1, {LONG_BYTES}) END AS head")
        .groupBy("key", "cell", "head")
        .agg(F.expr("count(1) AS cnt"))
    )
    best = cells.selectExpr(
        "*", "rank() OVER (PARTITION BY key ORDER BY cnt DESC, coalesce(head, cell)) AS place"
    ).filter(f"place <= {limit}")
    short = best.filter("head IS NULL").selectExpr("key", "cell AS value", "cnt")
    long = best.filter("head IS NOT NULL").select("key", "cell", "cnt")
    texts = _values(df, infos).filter(is_digested("value")).selectExpr("key", "value", f"{compact('value')} AS cell")
    full = texts.join(long, ["key", "cell"]).groupBy("key", "cell").agg(F.expr("first(value) AS value"), F.expr("first(cnt) AS cnt"))
    return short.unionByName(full.select("key", "value", "cnt"))
