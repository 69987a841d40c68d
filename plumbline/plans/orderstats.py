"""Exact quantiles and moments without sorting or shuffling a column.

One pass over all rows keeps a mergeable quantile sketch per column, whose
values just below and just above the wanted ranks are narrow brackets that should
hold them. A second pass counts: rows outside the brackets collapse, before the
shuffle, to one cell per gap; only the distinct values inside a bracket travel.
The cell counts give every rank exactly, so the sketch decides how much is
shuffled and never what the answer is. A bracket that misses its rank, or holds
too many rows to rank in one place, is narrowed and counted again; that begins at
some hundred million rows.

What reaches the driver is a fixed number of values per column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import literal
from plumbline.functions.stats import lerp
from plumbline.plans.bins import double_array, with_position
from plumbline.plans.longform import BATCH, melt

INF = float("inf")

# Size of a quantile sketch; columns of up to so many values need no brackets.
SKETCH_K = 4096
# Half-width of a bracket in rank errors of the sketch that hold 99 times in 100.
WIDTH = 2.0
# Groups of tasks whose sketches are merged first, so that no task merges those of all.
SLOTS = 64
# Rows that may lie strictly inside a bracket before it is narrowed first.
BRACKET_ROWS = 4_000_000
# Rounds after which narrowing or recounting fails: the input differs between scans.
MAX_ROUNDS = 12

POWER_SUMS = ("s1", "s2", "s3", "s4")


@dataclass
class Interval:
    """Where one wanted rank is believed to lie, ends included."""

    lo: float = -INF
    hi: float = INF
    interior: float = 0.0  # rows strictly between lo and hi, estimated or counted
    position: float = 0.5  # relative rank of the target among the interior rows

    @property
    def too_full(self) -> bool:
        return self.lo < self.hi and self.interior > BRACKET_ROWS


@dataclass
class Entry:
    """One column to rank: SQL text of a double, NULL where there is no value."""

    key: int
    value: str
    shift: float = 0.0
    intervals: list[Interval] = field(default_factory=list)

    def brackets(self) -> list[tuple[float, float]]:
        """The intervals as disjoint ascending (lo, hi) pairs."""
        merged: list[tuple[float, float]] = []
        for lo, hi in sorted({(i.lo, i.hi) for i in self.intervals}):
            if merged and lo <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], hi))
            else:
                merged.append((lo, hi))
        return merged


def _rank_error() -> float:
    """Half-width of a bracket as a share of the rows: the published error of a sketch of this size, widened."""
    return WIDTH * 2.296 / SKETCH_K**0.9021


def _sketched(
    df: DataFrame, probes: Sequence[tuple[int, str, Sequence[float]]]
) -> dict[int, tuple[int, list[float]]]:
    """Number of present values and estimated quantiles at the given ranks, per probe that has a value.

    One job that reads all rows once and shuffles a sketch per probe and task.
    """
    parts = []
    for start in range(0, len(probes), BATCH):
        batch = list(enumerate(probes[start : start + BATCH]))
        values = [f"{value} AS v{j}" for j, (_, value, _) in batch]
        sketches = [F.expr(f"kll_sketch_agg_double(v{j}, {SKETCH_K}) AS s{j}") for j, _ in batch]
        merged = (
            df.selectExpr(*values, f"spark_partition_id() % {SLOTS} AS slot")
            .groupBy("slot")
            .agg(*sketches)
            .agg(*[F.expr(f"kll_merge_agg_double(s{j}) AS s{j}") for j, _ in batch])
            .selectExpr("*", *[f"coalesce(kll_sketch_get_n_double(s{j}), 0L) AS n{j}" for j, _ in batch])
        )
        cells = [
            f"struct({key} AS key, n{j} AS n, CASE WHEN n{j} > 0 THEN "
            f"kll_sketch_get_quantile_double(s{j}, {double_array(ranks)}) END AS found)"
            for j, (key, _, ranks) in batch
        ]
        parts.append(merged.selectExpr(f"inline(array({', '.join(cells)}))"))
    rows = reduce(DataFrame.unionAll, parts).filter("n > 0").collect()
    return {r["key"]: (r["n"], r["found"]) for r in rows}


def _around(p: float, error: float) -> tuple[float, float]:
    return max(p - error, 0.0), min(p + error, 1.0)


def _propose(iv: Interval, lo: float, hi: float, p: float, error: float, rows: float) -> None:
    """Shrink an interval holding ``rows`` rows to the estimates around rank ``p``."""
    left, right = _around(p, error)
    if left > 0:
        iv.lo = lo
    if right < 1:
        iv.hi = hi
    iv.interior = rows * (right - left)


def _with_region(df: DataFrame, entries: list[Entry]) -> DataFrame:
    """Long form of the present values with their region code and shift.

    Code 4b is the gap before bracket b; 4b+1, 4b+2 and 4b+3 are its low end,
    its inside and its high end. Counting the ends apart keeps a value that
    repeats in a third of all rows to one cell.
    """
    ends = {e.key: [x for pair in e.brackets() for x in pair] for e in entries}
    constants = {
        "ends": {k: double_array(x) for k, x in ends.items()},
        "shift": {e.key: literal(float(e.shift)) for e in entries},
    }
    long = melt(df, [(e.key, e.value) for e in entries], constants).filter("value IS NOT NULL")
    long = with_position(long, "value", "ends", max(map(len, ends.values())), "pos")
    return long.selectExpr(
        "*", "CASE WHEN get(ends, pos - 1) = value THEN 2 * pos - 1 ELSE 2 * pos END AS region"
    )


def _region_bounds(brackets: list[tuple[float, float]], code: int) -> tuple[float, float]:
    b, kind = divmod(code, 4)
    if kind == 0:
        before = brackets[b - 1][1] if b > 0 else -INF
        return before, brackets[b][0] if b < len(brackets) else INF
    lo, hi = brackets[b]
    return {1: (lo, lo), 2: (lo, hi), 3: (hi, hi)}[kind]


def _cells(df: DataFrame, entries: list[Entry], moments: bool) -> DataFrame:
    """Rows per (key, region, value), the value kept in brackets only."""
    aggs = ["count(1) AS cnt"]
    if moments:
        d = "(value - shift)"
        powers = (d, f"{d} * {d}", f"{d} * {d} * {d}", f"({d} * {d}) * ({d} * {d})")
        aggs += [f"sum({x}) AS {s}" for s, x in zip(POWER_SUMS, powers)]
        aggs += ["min(value) AS min", "max(value) AS max", "count_if(value = 0) AS zero_count"]
    cell = F.expr("CASE WHEN region % 4 != 0 THEN value END").alias("cell")
    return (
        _with_region(df, entries)
        .groupBy("key", "region", cell)
        .agg(*map(F.expr, aggs))
    )


def _ranked(cells: DataFrame, probs: Sequence[float], moments: bool) -> DataFrame:
    """One row per key: count, sums, quantiles, and whether a rank fell in a gap.

    A window spans the cells of one column, which the brackets bound.
    """
    ranked = cells.selectExpr(
        "*",
        "sum(cnt) OVER (PARTITION BY key ORDER BY region, cell "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto",
        "sum(cnt) OVER (PARTITION BY key) AS n",
    )
    aggs = ["first(n) AS n"]
    if moments:
        aggs += [f"sum({s}) AS {s}" for s in POWER_SUMS]
        aggs += ["min(min) AS min", "max(max) AS max", "sum(zero_count) AS zero_count"]
    kept = ["key"] + [a.rsplit(" ", 1)[1] for a in aggs]
    missed, found = [], []
    for i, p in enumerate(probs):
        h = f"(n - 1) * {float(p)!r}D"
        for side, rank in ((f"lo{i}", f"floor({h})"), (f"hi{i}", f"ceil({h})")):
            here = f"{rank} < upto AND {rank} >= upto - cnt"
            aggs.append(f"max(CASE WHEN {here} THEN cell END) AS {side}")
            missed.append(f"{side} IS NULL")
        found.append(f"{lerp(f'lo{i}', f'hi{i}', f'({h} - floor({h}))')} AS q{i}")
    return (
        ranked.groupBy("key")
        .agg(*map(F.expr, aggs))
        .selectExpr(*kept, f"{' OR '.join(missed) or 'false'} AS missed", *found)
    )


def _locate(df: DataFrame, entries: list[Entry], probs: Sequence[float]) -> None:
    """Count rows per region exactly and move each interval to the region of its rank."""
    rows = _with_region(df, entries).groupBy("key", "region").count().collect()
    for e in entries:
        counts = sorted((r["region"], r["count"]) for r in rows if r["key"] == e.key)
        last = max(sum(c for _, c in counts) - 1, 0)
        brackets = e.brackets()
        for i, p in enumerate(probs):
            for iv, rank in zip(e.intervals[2 * i :], (math.floor(last * p), math.ceil(last * p))):
                below = 0
                for code, count in counts:
                    if rank < below + count:
                        iv.lo, iv.hi = _region_bounds(brackets, code)
                        iv.interior = count if code % 2 == 0 else 0
                        iv.position = (rank - below) / max(count - 1, 1)
                        break
                    below += count


def _narrow(df: DataFrame, entries: list[Entry]) -> None:
    """Sketch the inside of the intervals that are too full and shrink them."""
    full = [(e, iv) for e in entries for iv in e.intervals if iv.too_full]
    errors = [_rank_error() if iv.interior > SKETCH_K else 2 / iv.interior for _, iv in full]
    probes = []
    for j, ((e, iv), error) in enumerate(zip(full, errors)):
        inside = f"{e.value} > {literal(iv.lo)} AND {e.value} < {literal(iv.hi)}"
        probes.append((j, f"CASE WHEN {inside} THEN {e.value} END", _around(iv.position, error)))
    for j, (n, (lo, hi)) in _sketched(df, probes).items():
        iv = full[j][1]
        _propose(iv, lo, hi, iv.position, errors[j], n)


def _shrink(df: DataFrame, entries: list[Entry], probs: Sequence[float]) -> None:
    """Narrow until every interval is small enough to rank in one window."""
    for _ in range(MAX_ROUNDS):
        full = [e for e in entries if any(iv.too_full for iv in e.intervals)]
        if not full:
            return
        _locate(df, full, probs)
        full = [e for e in full if any(iv.too_full for iv in e.intervals)]
        if full:
            _narrow(df, full)
    if any(iv.too_full for e in entries for iv in e.intervals):
        raise RuntimeError("the intervals cannot be narrowed: does the table differ between scans?")


def proposed_statistics(
    df: DataFrame,
    columns: Sequence[tuple[int, str]],
    probs: Sequence[float],
    moments: bool = False,
) -> tuple[DataFrame, list[Entry]]:
    """The statistics as a lazy frame, from brackets that sketches propose.

    ``missed`` marks the columns where a bracket missed a rank; the others are
    exact.
    """
    entries = [Entry(k, v) for k, v in columns]
    error = _rank_error()
    ranks = [0.5] + [r for p in probs for r in _around(p, error)]
    found = _sketched(df, [(k, v, ranks) for k, v in columns])
    for e in entries:
        n, (middle, *ends) = found.get(e.key, (0, [0.0, *ranks[1:]]))
        e.shift = middle
        e.intervals = [Interval(interior=n) for _ in range(2 * len(probs))]
        if n > SKETCH_K:
            for i, p in enumerate(probs):
                for iv in e.intervals[2 * i : 2 * i + 2]:
                    _propose(iv, ends[2 * i], ends[2 * i + 1], p, error, n)
    _shrink(df, entries, probs)
    return _counted(df, entries, probs, moments), entries


def _counted(
    df: DataFrame, entries: list[Entry], probs: Sequence[float], moments: bool
) -> DataFrame:
    out = _ranked(_cells(df, entries, moments), probs, moments)
    if moments:
        # Keyed by column, so the literal map is as small as the schema.
        shifts = ", ".join(f"{e.key}, {literal(float(e.shift))}" for e in entries)
        out = out.withColumn("shift", F.expr(f"map({shifts})[key]"))
    return out


def order_statistics(
    df: DataFrame,
    columns: Sequence[tuple[int, str]],
    probs: Sequence[float],
    moments: bool = False,
) -> DataFrame:
    """Exact linear-interpolated quantiles ``q0, q1, ...`` per column.

    ``columns`` pairs a key with the SQL text of a double. The result has one row per key that has any value, with the
    count ``n`` and, if ``moments``, the sums of powers of ``x - shift``, the
    shift, minimum, maximum and zero count. It is cached: it holds as many rows
    as there are columns.
    """
    frame, pending = proposed_statistics(df, columns, probs, moments)
    done: list[DataFrame] = []
    for round_no in range(MAX_ROUNDS):
        part = frame.persist()
        missed = {r["key"] for r in part.filter("missed").select("key").collect()}
        done.append(part.filter("NOT missed").drop("missed") if missed else part.drop("missed"))
        pending = [e for e in pending if e.key in missed]
        if not pending:
            break
        if round_no + 1 == MAX_ROUNDS:
            raise RuntimeError(f"{len(pending)} columns keep missing a rank: does the table differ between scans?")
        _locate(df, pending, probs)
        _shrink(df, pending, probs)
        frame = _counted(df, pending, probs, moments)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def quantiles(
    df: DataFrame, columns: Sequence[tuple[int, str]], probs: Sequence[float]
) -> dict[int, list[float]]:
    """The same as driver values, for use as literals (fences, edges, medians)."""
    found = order_statistics(df, columns, probs).collect()
    return {r["key"]: [r[f"q{i}"] for i in range(len(probs))] for r in found}
