"""Two-sample distances between frequency tables."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import literal
from plumbline.functions.stats import psi_term
from plumbline.plans.bins import double_array, with_position
from plumbline.plans.longform import melt

# Buckets of equal width a column is cut into, and parts an undecided one is cut into again.
BUCKETS = 1 << 14
PARTS = 1 << 6
# Rows of an undecided part that one task may rank; a larger part is cut again, at most so often.
IN_TASK = 2_000_000
MAX_LEVELS = 40
# Undecided parts that may be broadcast (some 60 bytes each).
BROADCAST_PARTS = 200_000

# A column whose ends are so many interquartile ranges away is laid out in roots, at most so often.
LONG_TAIL = 64
MAX_ROOTS = 6
ROOTS = "CASE roots WHEN 0 THEN abs(d) " + " ".join(
    f"WHEN {k} THEN {'sqrt(' * k}abs(d){')' * k}" for k in range(1, MAX_ROOTS + 1)
) + " END"

IN_PART = (
    "PARTITION BY key, path ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
)

Entries = list[tuple[int, str, str]]  # key, reference value, current value (SQL text)
Totals = dict[int, tuple[int, int]]  # key -> present values per side


def _both_sides(
    ref: DataFrame,
    cur: DataFrame,
    entries: Entries,
    constants: Mapping[str, Mapping[int, str]] | None = None,
) -> DataFrame:
    """``key, value, r, c`` in long form: r or c is 1 for the side a value is from."""
    left = melt(ref, [(k, v) for k, v, _ in entries], constants).selectExpr("*", "1 AS r", "0 AS c")
    right = melt(cur, [(k, v) for k, _, v in entries], constants).selectExpr("*", "0 AS r", "1 AS c")
    return left.unionAll(right).filter("value IS NOT NULL")


def _paired_counts(long: DataFrame, *within: str) -> DataFrame:
    """Occurrences of each value on both sides, one shuffle."""
    return long.groupBy(*within, "value").agg(F.expr("sum(r) AS r"), F.expr("sum(c) AS c"))


def by_key(values: Mapping[int, str]) -> str:
    """SQL text that looks up a literal by ``key``: one per column of the input."""
    cells = ", ".join(values.get(k, "NULL") for k in range(max(values) + 1))
    return f"get(array({cells}), key)"


def _sizes(totals: Totals) -> tuple[str, str]:
    """SQL text of the present values per side, by ``key``."""
    ref = by_key({k: f"{pair[0]}L" for k, pair in totals.items()})
    return ref, by_key({k: f"{pair[1]}L" for k, pair in totals.items()})


@dataclass(frozen=True)
class Scale:
    """How a column is laid out before it is cut into buckets of equal width.

    ``roots`` square roots of the distance to ``mid`` draw long tails in. Each step
    is rounded correctly and so never changes the order of two values.
    """

    mid: float = 0.0
    roots: int = 0
    lo: float = 0.0
    scale: float = 0.0

    @classmethod
    def of(cls, lo: float, hi: float, q1: float, mid: float, q3: float) -> Scale:
        spread = max(hi - mid, mid - lo)
        usual = max(q3 - q1, spread * 1e-300, 1e-300)
        roots = 0
        while roots < MAX_ROOTS and (spread / usual) ** (0.5**roots) > LONG_TAIL:
            roots += 1

        def laid(x: float) -> float:
            out = abs(x - mid)
            for _ in range(roots):
                out = math.sqrt(out)
            return math.copysign(out, x - mid)

        width = laid(hi) - laid(lo)
        good = 0 < width < math.inf and BUCKETS / width < math.inf
        return cls(mid, roots, laid(lo), BUCKETS / width if good else 0.0)


def ks_distances(ref: DataFrame, cur: DataFrame, entries: Entries, totals: Totals) -> DataFrame:
    """``key, n_ref, n_cur, d``: the largest gap between the two empirical CDFs, exact.

    A first pass counts both sides in buckets, of equal width or, where the tails
    are long, of equal width in a root of the distance to the median; that combines
    to a row per bucket and task. It gives the gap at every bucket's end, and bounds
    the gap inside a bucket by the rows it holds. Buckets whose bound exceeds the
    largest gap seen are cut again between the least and the largest value they
    hold, and again, until each undecided part holds ``IN_TASK`` rows at most; only
    these are looked at by value. The bulk of the data is never shuffled. Values are
    counted before they are ranked, so repeats do not pile up, and a bucket of one
    value is decided. What an undecided part carries on is its offset, its least
    value, its width and the largest gap so far.
    """
    n_ref, n_cur = _sizes(totals)
    shapes = (
        _both_sides(ref, cur, entries)
        .filter("abs(value) < double('infinity')")
        .groupBy("key")
        .agg(
            F.expr("min(value) AS lo"),
            F.expr("max(value) AS hi"),
            F.expr("percentile_approx(value, array(0.25D, 0.5D, 0.75D), 100) AS q"),
        )
        .collect()  # one row per column
    )
    scales = {r["key"]: Scale.of(r["lo"], r["hi"], *r["q"]) for r in shapes}
    scales = {k: scales.get(k, Scale()) for k, _, _ in entries}
    constants = {
        name: {k: literal(getattr(x, name)) for k, x in scales.items()} for name in ("mid", "roots", "lo", "scale")
    }
    long = _both_sides(ref, cur, entries, constants)
    long = long.selectExpr("key", "value", "r", "c", "lo", "scale", "roots", "value - mid AS d")
    long = long.selectExpr("key", "value", "r", "c", "lo", "scale", f"signum(d) * ({ROOTS}) AS u")
    long = long.selectExpr("key", "value", "r", "c", f"{_place('u', 'lo', 'scale', BUCKETS)} AS bucket")
    coarse = _gaps(long, "key", "bucket", "0", "0", n_ref, n_cur)
    coarse = coarse.selectExpr("*", "max(gap) OVER (PARTITION BY key) AS reached").persist()
    # At most BUCKETS rows per column.
    state = _undecided(coarse).selectExpr(
        "key", "cast(bucket AS string) AS path", "br AS start_r", "bc AS start_c", "low",
        f"{_width('low', 'high', PARTS)} AS fine", "reached",
    )
    rows = long.selectExpr("key", "value", "r", "c", "cast(bucket AS string) AS path")
    found, open_parts = [coarse.selectExpr("key", "gap AS d")], None
    for _ in range(MAX_LEVELS):
        inside = rows.join(_small(state, open_parts), ["key", "path"]).selectExpr(
            "*", f"{_place('value', 'low', 'fine', PARTS)} AS part"
        )
        parts = _gaps(inside, "key, path, start_r, start_c, reached", "part", "start_r", "start_c", n_ref, n_cur)
        parts = parts.selectExpr(
            "* EXCEPT (reached)", "greatest(reached, max(gap) OVER (PARTITION BY key)) AS reached"
        ).persist()
        found.append(parts.selectExpr("key", "gap AS d"))
        left = _undecided(parts)
        open_parts, largest = left.agg(F.count(F.lit(1)), F.max(F.col("r") + F.col("c"))).first()
        if not open_parts:
            break
        rows = inside.selectExpr("key", "value", "r", "c", "concat(path, ',', part) AS path")
        state = left.selectExpr(
            "key", "concat(path, ',', part) AS path", "br AS start_r", "bc AS start_c", "low",
            f"{_width('low', 'high', PARTS)} AS fine", "reached",
        )
        if largest <= IN_TASK:
            break
    if open_parts:
        counted = _paired_counts(
            rows.join(_small(state, open_parts), ["key", "path"]).select("key", "path", "start_r", "start_c", "value", "r", "c"),
            "key", "path", "start_r", "start_c",
        )
        found.append(
            counted.selectExpr(
                "*", f"sum(r) OVER ({IN_PART}) AS cr", f"sum(c) OVER ({IN_PART}) AS cc"
            ).selectExpr("key", f"abs((start_r + cr) / {n_ref} - (start_c + cc) / {n_cur}) AS d")
        )
    found = reduce(DataFrame.unionAll, found).groupBy("key").agg(F.expr("max(d) AS d"))
    return found.selectExpr("key", f"{n_ref} AS n_ref", f"{n_cur} AS n_cur", "d")


def _small(state: DataFrame, rows: int | None) -> DataFrame:
    """``state`` to be broadcast if it was counted and is small, or is a row per bucket."""
    return F.broadcast(state) if rows is None or rows <= BROADCAST_PARTS else state


def _width(lo: str, hi: str, parts: int) -> str:
    inside = f"{hi} - {lo} > 0 AND {hi} - {lo} < double('infinity') AND {parts} / ({hi} - {lo}) < double('infinity')"
    return f"CASE WHEN {inside} THEN {parts} / ({hi} - {lo}) ELSE 0D END"


def _place(x: str, lo: str, scale: str, parts: int) -> str:
    """SQL text of the part a value is in: never falls as the value grows; infinities are parts of their own."""
    inner = f"cast(least({parts - 1}D, greatest(0D, floor(({x} - {lo}) * {scale}))) AS int)"
    return (
        f"CASE WHEN value = double('infinity') THEN {parts} WHEN value = double('-infinity') THEN -1 ELSE {inner} END"
    )


def _gaps(long: DataFrame, within: str, part: str, start_r: str, start_c: str, n_ref: str, n_cur: str) -> DataFrame:
    """Per part the rows before it, its rows, its least and largest value, and the gap at its end."""
    groups = [*within.split(", "), part]
    below = f"PARTITION BY {within} ORDER BY {part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return (
        long.groupBy(*groups)
        .agg(*map(F.expr, ("sum(r) AS r", "sum(c) AS c", "min(value) AS low", "max(value) AS high")))
        .selectExpr(
            "*",
            f"{start_r} + coalesce(sum(r) OVER ({below}), 0) AS br",
            f"{start_c} + coalesce(sum(c) OVER ({below}), 0) AS bc",
        )
        .selectExpr("*", f"abs((br + r) / {n_ref} - (bc + c) / {n_cur}) AS gap", f"{n_ref} AS nr", f"{n_cur} AS nc")
    )


def _undecided(parts: DataFrame) -> DataFrame:
    """Parts of several values within which the gap may exceed the largest one seen."""
    return parts.filter(
        "low < high AND greatest(abs((br + r) / nr - bc / nc), abs(br / nr - (bc + c) / nc)) > reached"
    )


def binned_counts(
    ref: DataFrame, cur: DataFrame, entries: Entries, edges: dict[int, list[float]]
) -> DataFrame:
    """``key, bin, r, c, sum_r, sum_c`` per edge bin; bin 0 holds what lies outside.

    Bins are half-open, the last one closed. Everything is combined before the
    shuffle: at most one row per bin and task.
    """

    used = [e for e in entries if e[0] in edges]
    bounds = {k: double_array(x) for k, x in edges.items()}
    both = _both_sides(ref, cur, used, {"edges": bounds})
    both = with_position(both, "value", "edges", max(map(len, edges.values())), "pos")
    place = F.expr(
        "CASE WHEN pos < size(edges) THEN pos "
        "WHEN element_at(edges, -1) = value THEN size(edges) - 1 ELSE 0 END AS bin"
    )
    return both.groupBy("key", place).agg(
        F.expr("sum(r) AS r"),
        F.expr("sum(c) AS c"),
        F.expr("sum(CASE WHEN r = 1 THEN value END) AS sum_r"),
        F.expr("sum(CASE WHEN c = 1 THEN value END) AS sum_c"),
    )


def psi_of(
    counts: DataFrame, totals: Totals, inside: str = "true", means: bool = False
) -> DataFrame:
    """``key, psi`` from the cell counts ``r`` and ``c`` of the cells ``inside``.

    ``means`` adds the mean of each side, from the sums of all cells.
    """
    n_ref, n_cur = _sizes(totals)
    term = psi_term(f"(r / {n_ref})", f"(c / {n_cur})")
    aggs = [f"sum(CASE WHEN {inside} THEN {term} END) AS psi"]
    if means:
        aggs += [
            "try_divide(sum(sum_r), sum(r)) AS ref_mean",
            "try_divide(sum(sum_c), sum(c)) AS cur_mean",
        ]
    return counts.groupBy("key").agg(*map(F.expr, aggs))


def category_psi(ref: DataFrame, cur: DataFrame, entries: Entries, totals: Totals) -> DataFrame:
    """``key, psi`` over the union of the values of both sides."""
    return psi_of(_paired_counts(_both_sides(ref, cur, entries), "key"), totals)
