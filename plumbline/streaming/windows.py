"""Profiles and drift of a stream by windows of event time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import as_double, describe_columns, ident, literal, numeric_columns
from plumbline.functions.stats import PSI_EPSILON, drift_status, percentage


def _windowed(stream: DataFrame, time_column: str, width: str, delay: str):
    """``stream`` grouped by windows of event time.

    A window is closed once rows ``delay`` younger than its end have come; rows for
    it that arrive a chunk after that, or later, are left out.
    """
    stamped = stream.withColumn("__time", F.expr(f"cast({ident(time_column)} AS timestamp)"))
    return stamped.filter("__time IS NOT NULL").withWatermark("__time", delay).groupBy(F.window("__time", width).alias("__window"))


def window_profile(
    stream: DataFrame, time_column: str, columns: Sequence[str] | None = None, width: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Counts and moments of each window: a stream of one row per window with a struct per column.

    The state holds a few numbers per open window and column, whatever the number
    of rows. A row whose time is missing belongs to no window.
    """
    infos = [c for c in describe_columns(stream, None if columns is None else list(columns)) if c.name != time_column]
    aggs = [F.count(F.lit(1)).alias("total")]
    for c in infos:
        present = f"nanvl({ident(c.name)}, NULL)" if c.dtype in ("float", "double") else ident(c.name)
        number = as_double(c) if c.family in ("numeric", "boolean") else "cast(NULL AS double)"
        aggs.append(
            F.struct(
                F.lit(c.name).alias("column"), F.expr(f"count({present})").alias("n"), F.expr(f"avg({number})").alias("mean"),
                F.expr(f"stddev_samp({number})").alias("std"), F.expr(f"min({number})").alias("min"),
                F.expr(f"max({number})").alias("max"), F.expr(f"count_if({number} = 0)").alias("zeros"),
            ).alias(f"c{c.ordinal}")
        )
    cells = ", ".join(f"c{c.ordinal}" for c in infos)
    out = _windowed(stream, time_column, width, delay).agg(*aggs)
    return out.selectExpr("cast(__window.start AS timestamp_ntz) AS window_start", "total", f"inline(array({cells}))").selectExpr(
        "window_start", "column", "total AS total_count", "total - n AS missing_count",
        f"{percentage('(total - n)', 'total')} AS missing_percentage", "mean", "std", "min", "max",
        "CASE WHEN mean IS NOT NULL THEN zeros END AS zero_count",
    )


def reference_bins(ref: DataFrame, columns: Sequence[str], bins: int = 10) -> dict[str, tuple[list[float], list[float]]]:
    """Edges and shares of equally filled bins of a reference table, per numeric column; a few numbers each."""
    from plumbline.plans.orderstats import quantiles

    infos = numeric_columns(ref, list(columns))
    found = quantiles(ref, [(c.ordinal, as_double(c)) for c in infos], [i / bins for i in range(bins + 1)])
    edges = {c.name: sorted(set(found[c.ordinal])) for c in infos if c.ordinal in found}
    edges = {n: e if len(e) > 1 else [e[0] - 1, e[0] + 1] for n, e in edges.items()}
    by_name = {c.name: c for c in infos}
    aggs, names = [], []
    for name, cuts in edges.items():
        for j, inside in enumerate(_bin_tests(as_double(by_name[name]), cuts)):
            aggs.append(F.expr(f"count_if({inside}) AS b{len(names)}"))
            names.append((name, j))
        aggs.append(F.expr(f"count({as_double(by_name[name])}) AS n_{by_name[name].ordinal}"))
    row = ref.agg(*aggs).first()
    out: dict[str, tuple[list[float], list[float]]] = {}
    for i, (name, _) in enumerate(names):
        shares = out.setdefault(name, (edges[name], []))[1]
        shares.append(row[f"b{i}"] / max(1, row[f"n_{by_name[name].ordinal}"]))
    return out


def _bin_tests(value: str, edges: Sequence[float]) -> list[str]:
    """Half-open bins, the last one closed."""
    last = len(edges) - 2
    return [
        f"{value} >= {literal(float(a))} AND {value} {'<=' if i == last else '<'} {literal(float(b))}"
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ]


def window_drift(
    stream: DataFrame,
    time_column: str,
    reference: Mapping[str, tuple[Sequence[float], Sequence[float]]],
    width: str = "1 day",
    delay: str = "1 hour",
) -> DataFrame:
    """The Population Stability Index of each window against a reference's bins: a stream of a row per window and column."""
    infos = {c.name: c for c in describe_columns(stream)}
    aggs, cells = [], []
    for name, (edges, shares) in reference.items():
        i, value = infos[name].ordinal, as_double(infos[name])
        tests = _bin_tests(value, edges)
        aggs.append(F.expr(f"count({value}) AS n{i}"))
        aggs += [F.expr(f"count_if({t}) AS b{i}_{j}") for j, t in enumerate(tests)]
        terms = []
        for j, share in enumerate(shares):
            ref = literal(float(share) or PSI_EPSILON)
            cur = f"(CASE WHEN b{i}_{j} = 0 THEN {PSI_EPSILON!r}D ELSE b{i}_{j} / n{i} END)"
            terms.append(f"({cur} - {ref}) * ln({cur} / {ref})")
        cells.append(f"named_struct('column', {literal(name)}, 'n', n{i}, 'psi', CASE WHEN n{i} > 0 THEN {' + '.join(terms)} ELSE 0D END)")
    out = _windowed(stream, time_column, width, delay).agg(*aggs)
    out = out.selectExpr("cast(__window.start AS timestamp_ntz) AS window_start", f"inline(array({', '.join(cells)}))")
    return out.selectExpr("*", f"{drift_status('psi')} AS drift_status")


def run_windows(windows: DataFrame, folder: str, keys: Sequence[str] = ("window_start", "column")) -> DataFrame:
    """Run a stream of windows over what is there; the last row of each window and column.

    Each chunk writes the windows it changed as a version of its own under the
    shared ``folder``: a chunk that is run again overwrites its version.
    """
    kept = f"{folder.rstrip('/')}/windows"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{kept}/version={batch_id}")

    query = (
        windows.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder.rstrip('/')}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = windows.sparkSession
    try:
        versions = spark.read.parquet(kept)
    except AnalysisException:  # no chunk came
        return spark.createDataFrame([], windows.schema)
    values = [c for c in windows.columns if c not in keys]
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("v"))
    return last.select(*keys, "v.*")
