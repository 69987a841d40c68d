"""Seeded samples of an exact size.

Every row draws a number that depends on the seed and the row alone, not on how
the table is split: rows of files by their file and place in it, other rows by
their content, copies numbered. A threshold slightly above the wanted share drops
all other rows in the scan; the smallest draws are the sample, which is kept.
Copies of one row draw on their own, so a row that fills a third of the table
fills about a third of the sample.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import ident

DRAW = "__draw"
STRATUM = "__stratum"
#: Rows of a sample that one task may sort; a larger one is cut by counted draws.
IN_TASK = 100_000
#: Cells in which draws are counted.
CELLS = 4096


def with_draw(df: DataFrame, seed: int) -> DataFrame:
    """``df`` with a draw in [0, 1) per row that stays when the table is split differently.

    A plain scan of Parquet files numbers its rows, which costs nothing. For other
    tables, joins and exploded rows among them, the copies of a row are numbered,
    which shuffles the table once: write it to Parquet first to spare that.
    """
    uniform = lambda h: F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))
    if _has_places(df):
        place = F.xxhash64(F.lit(seed), F.col("_metadata.file_name"), F.col("_metadata.row_index"))
        return df.select("*", uniform(place).alias(DRAW))
    row = F.xxhash64(F.lit(seed), *[F.to_json(F.struct(F.col(ident(c)))) for c in df.columns])
    copy = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
    numbered = df.select("*", row.alias("__row")).select("*", copy.alias("__copy"))
    return numbered.select("*", uniform(F.xxhash64(F.lit(seed), "__row", "__copy")).alias(DRAW)).drop("__row", "__copy")


#: Plan steps that give each row of a scan at most once, as they are named in a plan.
ONE_TO_ONE = {"Project", "Filter", "SubqueryAlias", "View", "Sort", "Repartition", "RepartitionByExpression"}


def _has_places(df: DataFrame) -> bool:
    """True if the rows are those of one scan of files that number their rows, each at most once.

    A join or an exploded array gives a row's place to several rows, so the plan
    may hold nothing but steps that keep or drop single rows above its scan.
    """
    names = [p.lower().rsplit(".", 1)[-1] for p in df.inputFiles()[:1]]
    if names != ["parquet"]:
        return False
    try:
        df.select("_metadata.file_name", "_metadata.row_index")
        node = df._jdf.queryExecution().analyzed()
        while node.children().size() == 1 and node.nodeName() in ONE_TO_ONE:
            node = node.children().apply(0)
    except (AnalysisException, AttributeError, NotImplementedError):
        return False
    return node.children().size() == 0


def _enough(k: float) -> float:
    """Rows to let through so that at least ``k`` arrive, up to a chance below 1e-15."""
    return k + 10 * k**0.5 + 50


def _cut(drawn: DataFrame, n: int, share: float) -> tuple[float, int]:
    """The ``n``-th smallest draw below ``share``, and how many rows of exactly that draw belong to the ``n``.

    Draws are counted in ``CELLS`` equal cells, then in those of the cell that
    holds the ``n``-th, until one draw is left: a few thousand counts reach the
    driver each time, and no task sees more than its own rows.
    """
    lo, hi, left = 0.0, share, n
    while True:
        inside = drawn.filter((F.col(DRAW) >= lo) & (F.col(DRAW) < hi))
        width = (hi - lo) / CELLS
        cell = F.least(F.floor((F.col(DRAW) - lo) / width), F.lit(CELLS - 1))
        found = inside.groupBy(cell.alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min(DRAW).alias("low"), F.max(DRAW).alias("high")
        )
        for r in sorted(found.collect(), key=lambda r: r["cell"]):
            if left <= r["n"]:
                break
            left -= r["n"]
        else:
            raise RuntimeError("too few rows were drawn: does the table differ between scans?")
        if r["low"] == r["high"]:
            return r["low"], left
        lo, hi = r["low"], math.nextafter(r["high"], 2.0)


def sample_rows(
    df: DataFrame, n: int = 1000, seed: int = 42, stratify_by: str | None = None, rows: int | None = None
) -> DataFrame:
    """Exactly ``n`` rows without replacement, or all of them if there are no more.

    With ``stratify_by``, every stratum gives its rounded share of ``n``. The rows
    with the smallest draws are the sample: up to ``IN_TASK`` of them are found by
    a top-n, more by a distributed cut, which no task holds.
    """
    rows = df.count() if rows is None else rows
    if rows <= n:
        return df
    if stratify_by and stratify_by in df.columns:
        return sample_stratified(df, stratify_by, n, seed, rows)
    share = min(1.0, _enough(n) / rows)
    drawn = with_draw(df, seed).filter(F.col(DRAW) < share)
    if n <= IN_TASK:
        return drawn.orderBy(DRAW).limit(n).drop(DRAW).persist()
    at, ties = _cut(drawn, n, share)
    below, level = drawn.filter(F.col(DRAW) < at), drawn.filter(F.col(DRAW) == at)
    row = F.to_json(F.struct(*[F.col(ident(c)) for c in df.columns]))
    return below.unionByName(level.orderBy(row).limit(ties)).drop(DRAW)


def sample_stratified(df: DataFrame, by: str, n: int, seed: int = 42, rows: int | None = None) -> DataFrame:
    """``bround(n / rows * size)`` rows of every stratum; rows without a stratum are left out.

    Each stratum's threshold comes first, so the window ranks a sample-sized
    part of a stratum and never the whole of a large one.
    """
    rows = df.count() if rows is None else rows
    rate = min(1.0, n / max(rows, 1))
    strata = (
        df.filter(F.col(by).isNotNull())
        .groupBy(F.col(by).alias(STRATUM))
        .agg(F.count(F.lit(1)).alias("__size"))
        .withColumn("__take", F.bround(F.col("__size") * rate, 0))
        .persist()
    )
    wanted = strata.filter("__take > 0")
    enough = F.col("__take") + 10 * F.sqrt("__take") + 50
    wanted = wanted.select(STRATUM, "__take", (enough / F.col("__size")).alias("__share"))
    # The side with a row per stratum is chosen, and a large stratum split, at run time.
    drawn = with_draw(df, seed).join(wanted, F.col(by) == F.col(STRATUM))
    seat = F.row_number().over(Window.partitionBy(STRATUM).orderBy(DRAW))
    return (
        drawn.filter(F.col(DRAW) < F.col("__share"))
        .withColumn("__seat", seat)
        .filter(F.col("__seat") <= F.col("__take"))
        .select(*df.columns)
    )
