"""Cross products of many columns, block by block.

A table of some hundred columns has tens of thousands of pairs, so a row per
row and pair is out of the question. Each task multiplies blocks of columns in
numpy, batch by batch, and sends one small matrix per pair of blocks; matrices of
a pair of blocks are added in lots first, then over the lots. A task takes its
centres from the first values it sees, and sums are moved to common centres where
they are added, so the table is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block; a pair of blocks is one matrix of its square and four sums.
BLOCK = 64
#: Lots into which the tasks' matrices are added first.
LOTS = 32

_SCHEMA = "left int, right int, left_centres binary, right_centres binary, sums binary"


def block_sums(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """``left, right, left_centres, right_centres, sums``: a row per pair of blocks with left <= right.

    ``values`` are SQL texts of doubles, NULL where missing; ``sums`` are float64
    matrices of the rows where both columns are present: their number, the sums
    of x and of x^2 for the left and then the right column, and of their
    products, each less its centre (NaN for a column without finite values).
    """
    wide = len(values)

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        cuts = list(range(0, wide, BLOCK))
        held: dict[tuple[int, int], np.ndarray] = {}
        middle = np.full(wide, np.nan)
        for batch in batches:
            x = np.stack([batch.column(i).fill_null(float("nan")).to_numpy(zero_copy_only=False) for i in range(wide)])
            there = (~np.isnan(x)).astype(np.float64)
            for i in np.flatnonzero(np.isnan(middle)):  # until now such a column has added nothing finite
                finite = x[i][np.isfinite(x[i])]
                middle[i] = finite.mean() if len(finite) else np.nan
            x = np.where(there > 0, x - np.nan_to_num(middle)[:, None], 0.0)
            square = x * x
            for i, a in enumerate(cuts):
                u = slice(a, a + BLOCK)
                for j, b in enumerate(cuts[i:], i):
                    v = slice(b, b + BLOCK)
                    new = np.stack(
                        [
                            there[u] @ there[v].T, x[u] @ there[v].T, there[u] @ x[v].T,
                            square[u] @ there[v].T, there[u] @ square[v].T, x[u] @ x[v].T,
                        ]
                    )
                    held[i, j] = held[i, j] + new if (i, j) in held else new
        for (i, j), sums in held.items():
            ends = (middle[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in (i, j))
            yield pa.record_batch(
                [
                    pa.array([i], pa.int32()), pa.array([j], pa.int32()),
                    *(pa.array([raw], pa.binary()) for raw in (*ends, sums.tobytes())),
                ],
                ["left", "right", "left_centres", "right_centres", "sums"],
            )

    def moved(sums, dx, dy):
        """The six sums about centres that are lower by ``dx`` for the left columns and by ``dy`` for the right ones."""
        import numpy as np

        n, sx, sy, sxx, syy, sxy = sums
        dx, dy = dx[:, None], dy[None, :]
        return np.stack(
            [
                n, sx + n * dx, sy + n * dy, sxx + 2 * dx * sx + n * dx * dx, syy + 2 * dy * sy + n * dy * dy,
                sxy + dx * sy + dy * sx + n * dx * dy,
            ]
        )

    def added(group):
        import numpy as np
        import pandas as pd

        own = {s: [np.frombuffer(c, np.float64) for c in group[f"{s}_centres"]] for s in ("left", "right")}
        common = {s: own[s][0].copy() for s in own}
        for side, centres in own.items():
            for c in centres:
                common[side] = np.where(np.isnan(common[side]), c, common[side])
        total = 0.0
        for raw, a, b in zip(group["sums"], own["left"], own["right"], strict=True):
            sums = np.frombuffer(raw, np.float64).reshape(6, len(a), len(b))
            total = total + moved(sums, np.nan_to_num(a - common["left"]), np.nan_to_num(b - common["right"]))
        row = group.iloc[0]
        return pd.DataFrame(
            {
                "left": [row["left"]], "right": [row["right"]], "left_centres": [common["left"].tobytes()],
                "right_centres": [common["right"].tobytes()], "sums": [total.tobytes()],
            }
        ).astype({"left": "int32", "right": "int32"})

    # Whole-stage code of some dozen expressions is one method, too long for the JVM to compile; a lambda
    # in the projection keeps it out of that, and Spark then writes a short method per few expressions.
    first, *rest = values
    apart = [f"get(transform(array({first}), x -> x), 0)", *rest]
    cells = df.selectExpr(*[f"{v} AS c{i}" for i, v in enumerate(apart)])
    parts = cells.mapInArrow(multiply, _SCHEMA).withColumn("lot", F.spark_partition_id() % LOTS)
    lots = parts.groupBy("left", "right", "lot").applyInPandas(lambda g: added(g), _SCHEMA)
    return lots.groupBy("left", "right").applyInPandas(lambda g: added(g), _SCHEMA)


def correlations(sums: DataFrame, wide: int) -> DataFrame:
    """``a, b, r`` of each pair of column numbers a < b; NULL where a column is constant over the pair's rows."""

    def pairs(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for left, right, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
                rows = min(BLOCK, wide - left * BLOCK)
                n, sx, sy, sxx, syy, sxy = np.frombuffer(raw, np.float64).reshape(6, rows, -1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    spread = np.sqrt(np.maximum(n * sxx - sx * sx, 0)) * np.sqrt(np.maximum(n * syy - sy * sy, 0))
                    r = (n * sxy - sx * sy) / spread
                a, b = np.indices(r.shape)
                a, b = a + left * BLOCK, b + right * BLOCK
                keep = a < b
                found = r[keep]
                yield pa.record_batch(
                    [
                        pa.array(a[keep].astype("i4")), pa.array(b[keep].astype("i4")),
                        pa.array(found, mask=~np.isfinite(found)),
                    ],
                    ["a", "b", "r"],
                )

    return sums.mapInArrow(pairs, "a int, b int, r double")
