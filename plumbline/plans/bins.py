"""Locating values among sorted edges, as plain codegen expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from plumbline.functions.columns import ident, literal


def double_array(values: Sequence[float]) -> str:
    """SQL text of a constant array of doubles."""
    if not values:
        return "cast(array() AS array<double>)"
    return f"array({', '.join(literal(float(v)) for v in values)})"


def with_position(df: DataFrame, value: str, edges: str, longest: int, out: str) -> DataFrame:
    """Add ``out``: how many of the row's ascending ``edges`` are <= ``value``.

    A binary search unrolled into ``log2(longest)`` projections of one
    generated loop, each an alias of the one before. Reading past the end of a
    shorter array gives NULL, which compares as "not reached".
    """
    steps, last = [], "0"
    for s in reversed(range(longest.bit_length())):
        reached = f"get({edges}, {last} + {(1 << s) - 1}) <= {value}"
        name = f"__at{s}"
        steps.append(f"CASE WHEN {reached} THEN {last} + {1 << s} ELSE {last} END AS {name}")
        last = name
    kept = [ident(c) for c in df.columns]
    return df.selectExpr(*kept, *steps).selectExpr(*kept, f"{last} AS {ident(out)}")
