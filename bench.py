"""Time the headline queries and print one JSON line.

Every query runs once to warm up and is then timed, the faster of two runs;
results are fetched in full. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` set the tables
and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from catalog.inputs import AS_OF, drift_pair, order_pair, table
from plumbline import analyze
from plumbline.operators import charts, constraints, drift, profile, rows, sampling, structure

RULES = {"l_quantity": {"min": 5, "max": 45}, "l_returnflag": {"allowed": ["A", "N"]}}


def _line_pair(spark, sf):
    line = table(spark, sf, "lineitem")
    split = "TIMESTAMP_NTZ '1998-01-01 00:00:00'"
    return line.filter(f"l_shipdate < {split}"), line.filter(f"l_shipdate >= {split}")


def _both(found):
    return [found.profile, found.issues]


QUERIES = {
    "profile_lineitem": lambda s, sf: [analyze(table(s, sf, "lineitem")).profile],
    "profile_events": lambda s, sf: [analyze(table(s, sf, "events"), as_of=AS_OF).profile],
    "profile_documents": lambda s, sf: [analyze(table(s, sf, "documents")).profile],
    "profile_sampled": lambda s, sf: [
        analyze(sampling.sample_rows(table(s, sf, "lineitem"), 1000)).profile
    ],
    "analysis_orders": lambda s, sf: _both(analyze(table(s, sf, "orders"), as_of=AS_OF)),
    "analysis_lineitem": lambda s, sf: _both(analyze(table(s, sf, "lineitem"))),
    "missing_counts": lambda s, sf: [profile.missing_counts(table(s, sf, "lineitem"))],
    "outlier_rows": lambda s, sf: [rows.problem_rows(table(s, sf, "events"), "value", "outliers")],
    "constraints": lambda s, sf: [constraints.constraint_report(table(s, sf, "lineitem"), RULES)],
    "drift_events": lambda s, sf: [drift.drift_table(*drift_pair(s, sf))],
    "drift_orders": lambda s, sf: [drift.drift_table(*order_pair(s, sf))],
    "drift_lineitem": lambda s, sf: [drift.drift_table(*_line_pair(s, sf))],
    "correlation": lambda s, sf: [structure.correlation_pairs(table(s, sf, "lineitem"))],
    "histogram": lambda s, sf: [charts.histogram(table(s, sf, "lineitem"))],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plumbline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, query in QUERIES.items():
        runs = []
        for _ in range(3):
            spark.catalog.clearCache()
            start = time.perf_counter()
            for frame in query(spark, sf_dir):
                frame.collect()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
