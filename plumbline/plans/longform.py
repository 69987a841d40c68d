"""Long form: one row per (column, cell) of a set of columns of one type."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame

# Columns per array. A wider table becomes a union of scans, each of which reads
# only its own columns, so generated code stays within JIT limits.
BATCH = 64


def melt(
    df: DataFrame,
    entries: Sequence[tuple[int, str]],
    constants: Mapping[str, Mapping[int, str]] | None = None,
    key: str = "key",
) -> DataFrame:
    """Turn each entry ``(key, SQL text of a value)`` into its own row ``key, value``.

    All values have the same type. ``constants`` adds further columns, whose
    value per key is a literal (SQL text): it is looked up in a constant array,
    so literals of one column never need a join.
    """
    parts = []
    for start in range(0, len(entries), BATCH):
        batch = entries[start : start + BATCH]
        cells = ", ".join(value for _, value in batch)
        keys = [k for k, _ in batch]
        ident = "pos" if keys == list(range(len(keys))) else f"get(array({_join(keys)}), pos)"
        extra = [
            f"get(array({_join(by_key[k] for k in keys)}), pos) AS {name}"
            for name, by_key in (constants or {}).items()
        ]
        parts.append(
            df.selectExpr(f"posexplode(array({cells})) AS (pos, value)").selectExpr(
                f"{ident} AS {key}", "value", *extra
            )
        )
    return reduce(DataFrame.unionAll, parts)


def _join(items: Iterable) -> str:
    return ", ".join(map(str, items))
