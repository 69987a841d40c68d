"""Queries of the operators that keep states, sketches or mappings, with their SQL.

Estimates are compared as the answer to whether they are within their error of
the exact value, which the query works out beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.inputs import SPLIT, dirty_events, drift_pair, table
from catalog.oracles import ORACLES, _categories, _r, _rel, _union
from catalog.queries import _scratch, plain, query
from plumbline import analyze
from plumbline.operators import charts, constraints, duplicates, sampling, spelling, states, structure
from plumbline.sources.tables import write_table
from plumbline.streaming import windows

WIDE = 40
SEED_ROWS = 1000


def _close(df: DataFrame, estimates: DataFrame, infos: list[str], share: float) -> DataFrame:
    """``estimates`` with ``unique_close``: its ``unique_count`` is within ``share`` of the exact one."""
    exact = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in infos])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in infos])))
    near = F.abs(F.col("unique_count") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * share)
    return estimates.join(F.broadcast(exact), "column").withColumn("unique_close", near)  # a row per column


@query
def profile_approx_distinct(spark, sf):
    """Distinct counts from sketches within 2 %, the rest of the profile as ever."""
    line = table(spark, sf, "lineitem")
    found = _close(line, analyze(line, approx_distinct=True).profile, line.columns, 0.02)
    return plain(found.select("column", "total_count", "missing_count", "mean", "std", "median", "q1", "q3", "unique_close"))


@query
def profile_exact_range(spark, sf):
    """Ends of integer and decimal columns beyond what a double holds."""
    orders = table(spark, sf, "orders").selectExpr(
        "9007199254740993 + o_orderkey AS big", "cast(o_totalprice AS decimal(30, 2)) * 100000000000000BD AS money", "o_custkey"
    )
    return plain(analyze(orders).profile.select("column", "min_exact", "max_exact"))


def _day_states(spark, sf):
    events = dirty_events(spark, sf).withColumn("day", F.to_date("ts"))
    path = _scratch(spark, "states")
    write_table(states.profile_states(events, ["day"]), path, "parquet")
    return spark.read.parquet(path)


STATE_COLUMNS = (
    "total_count", "missing_count", "missing_percentage", "mean", "std", "min", "max", "min_whole", "max_whole", "skew", "kurtosis",
    "zero_count", "min_date", "max_date",
)


@query
def profile_merged_states(spark, sf):
    """The profile of all events from stored states of their days: counts, moments and ranges are exact."""
    return plain(states.profile_from_states(_day_states(spark, sf)).select("column", *STATE_COLUMNS))


@query
def profile_states_by_day(spark, sf):
    """The states of each day by themselves."""
    found = states.profile_from_states(_day_states(spark, sf), ["day"])
    out = found.select(F.col("day").cast("string").alias("day"), "column", "total_count", "missing_count", "mean", "std", "min", "max")
    return plain(out)


@query
def profile_merged_estimates(spark, sf):
    """Sketches of the days, united: distinct counts within 2 %, quartiles within 1 % of the ranks, top values exact."""
    events = dirty_events(spark, sf)
    merged = states.profile_from_states(_day_states(spark, sf))
    close = _close(events, merged, ["event_id", "ts", "user_id", "event_type", "is_large", "props"], 0.02)
    value = F.nanvl("value", F.lit(None).cast("double"))
    q = merged.filter("column = 'value'").select("q1", "median", "q3")
    ranks = [
        F.count_if(value < F.col(c)).alias(f"below_{c}") for c in ("q1", "median", "q3")
    ] + [F.count_if(value <= F.col(c)).alias(f"upto_{c}") for c in ("q1", "median", "q3")]
    row = events.crossJoin(F.broadcast(q)).agg(F.count(value).alias("n"), *ranks)  # one row of quartiles
    inside = F.lit(True)
    for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        inside = inside & (F.col(f"below_{c}") <= (p + 0.01) * F.col("n")) & (F.col(f"upto_{c}") >= (p - 0.01) * F.col("n"))
    quartiles = row.select(F.lit("value").alias("column"), inside.alias("close"))
    return close.select("column", F.col("unique_close").alias("close")).unionByName(quartiles)


DUPLICATE_KEY = ["l_returnflag", "l_quantity", "l_discount", "l_tax"]


@query
def duplicate_summary(spark, sf):
    return duplicates.duplicate_summary(table(spark, sf, "lineitem"), DUPLICATE_KEY)


@query
def duplicate_whole_rows(spark, sf):
    """Whole rows, missing cells among them, after copies of every seventh row were planted."""
    rows = dirty_events(spark, sf)
    return duplicates.duplicate_summary(rows.unionByName(rows.filter("event_id % 7 = 0")).unionByName(rows.filter("event_id % 21 = 0")))


@query
def duplicate_groups(spark, sf):
    return plain(duplicates.duplicate_groups(table(spark, sf, "lineitem"), DUPLICATE_KEY))


@query
def duplicate_members(spark, sf):
    found = duplicates.duplicate_members(table(spark, sf, "lineitem"), DUPLICATE_KEY)
    return plain(found.select("l_orderkey", "l_linenumber", *DUPLICATE_KEY, "copies"))


@query
def canonical_spelling(spark, sf):
    events = dirty_events(spark, sf)
    out = spelling.canonical_spelling(events.withColumn("props", F.expr("CASE WHEN event_id % 3 = 0 THEN upper(props) ELSE props END")), ["event_type", "props"])
    return out.select("event_id", "event_type", "props")


@query
def top_categories_documents(spark, sf):
    """All text columns, whole texts among them."""
    return plain(charts.top_categories(table(spark, sf, "documents")))


def _rule_table(spark, sf):
    """A rule for each part and supplier that may be ordered, and ranges."""
    parts = table(spark, sf, "part").filter("p_partkey % 10 != 0").selectExpr("'l_partkey' AS column", "'allowed' AS kind", "array(cast(p_partkey AS string)) AS args")
    flags = spark.sql(
        "SELECT * FROM VALUES ('l_returnflag', 'allowed', array('A', 'N')), ('l_quantity', 'min', array('5')), "
        "('l_quantity', 'min', array('3')), ('l_quantity', 'max', array('45')), ('no_such', 'min', array('1')) AS t(column, kind, args)"
    )
    return parts.unionByName(flags)


@query
def constraints_rule_table(spark, sf):
    return plain(constraints.rule_table_report(table(spark, sf, "lineitem"), _rule_table(spark, sf)))


@query
def rows_rule_table(spark, sf):
    line = table(spark, sf, "lineitem")
    found = constraints.rule_table_rows(line, _rule_table(spark, sf), "l_partkey")
    return plain(found.select("l_orderkey", "l_linenumber", "l_partkey"))


def _wide(i: int, mod: str) -> str:
    return f"l_quantity * {i % 7 + 1} + {mod.format('l_partkey', i + 3)} * {i} + l_extendedprice / {i + 1}"


@query
def correlation_wide(spark, sf):
    """More columns than pairs could be exploded for."""
    cols = [F.expr(f"CASE WHEN l_orderkey % {i + 5} != 0 THEN {_wide(i, '({} % {})')} END").alias(f"w{i}") for i in range(WIDE)]
    return plain(structure.correlation_pairs(table(spark, sf, "lineitem").select(*cols)))


def _event_stream(spark, sf, chunks=4):
    """The events as files that arrive in the order of their time."""
    events = table(spark, sf, "events")
    path = _scratch(spark, "arriving")
    bounds = events.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    step = (bounds["b"] - bounds["a"]) // chunks + 1
    for k in range(chunks):
        low = bounds["a"] + k * step
        events.filter((F.col("event_id") >= low) & (F.col("event_id") < low + step)).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def stream_window_profile(spark, sf):
    """Events by the hour as they arrive; a delay above the disorder of the files keeps every row."""
    stream = _event_stream(spark, sf)
    hours = windows.window_profile(stream, "ts", ["value", "user_id", "event_type"], "1 hour", "60 days")
    return plain(windows.run_windows(hours, _scratch(spark, "hours")))


@query
def stream_window_drift(spark, sf):
    """The index of each day against the bins of the days before the split."""
    ref, _ = drift_pair(spark, sf)
    bins = windows.reference_bins(ref, ["value"])
    days = windows.window_drift(_event_stream(spark, sf), "ts", bins, "1 day", "60 days")
    return plain(windows.run_windows(days, _scratch(spark, "days")))


@query
def sample_exploded(spark, sf):
    """A sample of rows that come tenfold from one scan: as many orders as independent draws give, within five deviations."""
    rows = table(spark, sf, "orders").withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(10))))
    n = rows.count()
    found = sampling.sample_rows(rows, SEED_ROWS).agg(
        F.count(F.lit(1)).alias("sampled"), F.count_distinct("o_orderkey", "part").alias("distinct_rows"), F.count_distinct("o_orderkey").alias("orders")
    )
    # Each order comes with a chance of hit; the number of orders varies about as a binomial one.
    hit = 1 - (1 - SEED_ROWS / n) ** 10
    near = F.abs(F.col("orders") - n / 10 * hit) <= 5 * (n / 10 * hit * (1 - hit)) ** 0.5 + 5
    return found.select("sampled", "distinct_rows", near.alias("unbiased"))


def _states_sql(day: bool) -> str:
    rel = _rel("dirty_events")
    head = "strftime(ts, '%Y-%m-%d') AS day, " if day else ""
    group = "GROUP BY 1" if day else ""
    out = []
    for column, kind in (("event_id", "whole"), ("ts", "date"), ("user_id", "whole"), ("event_type", "text"), ("value", "double"), ("is_large", "bool"), ("props", "text")):
        number = kind in ("whole", "double", "bool")
        d = f"CAST(CAST({column} AS INTEGER) AS DOUBLE)" if kind == "bool" else f"CAST({column} AS DOUBLE)"
        r = lambda e: _r(e) if number else "CAST(NULL AS DOUBLE)"  # noqa: E731, B023
        missing = f"(count(*) - count({column}))"
        cells = [
            f"'{column}' AS \"column\"", "count(*) AS total_count", f"{missing} AS missing_count",
            f"{r(f'avg({d})')} AS mean", f"{r(f'stddev_samp({d})')} AS std", f"{r(f'min({d})')} AS min", f"{r(f'max({d})')} AS max",
        ]
        if not day:
            whole = lambda f: f"{f}({column})" if kind == "whole" else "CAST(NULL AS BIGINT)"  # noqa: E731, B023
            date = lambda f: f"strftime({f}({column}), '%Y-%m-%d %H:%M:%S.%f')" if kind == "date" else "CAST(NULL AS VARCHAR)"  # noqa: E731, B023
            cells += [
                f"{_r(f'{missing} * 100.0e0 / count(*)')} AS missing_percentage", f"{whole('min')} AS min_whole", f"{whole('max')} AS max_whole",
                f"{r(f'skewness({d})')} AS skew", f"{r(f'kurtosis({d})')} AS kurtosis",
                (f"count(*) FILTER ({d} = 0)" if number else "CAST(NULL AS BIGINT)") + " AS zero_count",
                f"{date('min')} AS min_date", f"{date('max')} AS max_date",
            ]
        out.append(f"SELECT {head}{', '.join(cells)} FROM {rel} t {group}")
    return _union(out)


_GROUP = ", ".join(DUPLICATE_KEY)
_COUNTED = f"SELECT {_GROUP}, count(*) AS copies FROM lineitem GROUP BY ALL"


def _duplicates_sql(counted: str) -> str:
    return f"""SELECT CAST(sum(copies) AS BIGINT) AS "rows", count(*) AS distinct_rows, count(*) FILTER (copies > 1) AS duplicate_groups,
  CAST(sum(copies - 1) AS BIGINT) AS duplicate_rows, max(copies) AS largest_group FROM ({counted})"""


def _spelling_sql() -> str:
    rel = f"(SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN upper(props) ELSE props END AS props FROM {_rel('dirty_events')} e)"
    best = """SELECT lower(trim(v)) AS k, first(v ORDER BY c DESC, v) AS kept FROM
      (SELECT {c} AS v, count(*) AS c FROM {rel} t WHERE {c} IS NOT NULL GROUP BY 1) GROUP BY 1"""
    return f"""SELECT event_id, a.kept AS event_type, b.kept AS props FROM {rel} t
  LEFT JOIN ({best.format(c="event_type", rel=rel)}) a ON lower(trim(event_type)) = a.k
  LEFT JOIN ({best.format(c="props", rel=rel)}) b ON lower(trim(props)) = b.k"""


_BAD_PART = "l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 != 0)"


def _rule_sql() -> str:
    row = "SELECT '{0}' AS \"column\", '{1}' AS \"constraint\", count({0}) AS checked_count, count(*) FILTER ({2}) AS violations, {3} AS violation_percentage FROM lineitem"
    cells = [("l_quantity", "range", "l_quantity < 5 OR l_quantity > 45"), ("l_partkey", "allowed", _BAD_PART), ("l_returnflag", "allowed", "l_returnflag NOT IN ('A', 'N')")]
    return _union([row.format(c, k, bad, _r(f"count(*) FILTER ({bad}) * 100.0e0 / count({c})")) for c, k, bad in cells])


def _wide_sql() -> str:
    cols = ", ".join(f"CASE WHEN l_orderkey % {i + 5} != 0 THEN {_wide(i, '({} % {})')} END AS w{i}" for i in range(WIDE))
    pairs = [
        f"SELECT 'w{i}' AS col1, 'w{j}' AS col2, {_r(f'corr(w{i}, w{j})')} AS r FROM wide" for i in range(WIDE) for j in range(i + 1, WIDE)
    ]
    return f"WITH wide AS MATERIALIZED (SELECT {cols} FROM lineitem) " + _union(pairs)


def _hours_sql() -> str:
    parts = []
    for c in ("value", "user_id", "event_type"):
        number = c != "event_type"
        r = lambda e: _r(e) if number else "CAST(NULL AS DOUBLE)"  # noqa: E731, B023
        zeros = f"count(*) FILTER ({c} = 0)" if number else "CAST(NULL AS BIGINT)"
        parts.append(
            f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, '{c}' AS \"column\", count(*) AS total_count, "
            f"count(*) - count({c}) AS missing_count, {_r(f'(count(*) - count({c})) * 100.0e0 / count(*)')} AS missing_percentage, "
            f"{r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {zeros} AS zero_count "
            f"FROM events GROUP BY date_trunc('hour', ts)"
        )
    return _union(parts)


_DRIFT_SQL = f"""
WITH ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '{SPLIT}'),
edges AS (SELECT DISTINCT unnest(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM ref),
bins AS (SELECT e AS a, lead(e) OVER (ORDER BY e) AS b, row_number() OVER (ORDER BY e) AS i, count(*) OVER () - 1 AS k FROM edges QUALIFY b IS NOT NULL),
shares AS (SELECT i, a, b, k, greatest(count(value) * 1.0e0 / (SELECT count(value) FROM ref), 0) AS s
  FROM bins LEFT JOIN ref ON value >= a AND (value < b OR (i = k AND value <= b)) GROUP BY ALL),
days AS (SELECT date_trunc('day', ts) AS d, value FROM events),
totals AS (SELECT d, count(value) AS n FROM days GROUP BY 1),
cells AS (SELECT t.d, n, i, s, (SELECT count(*) FROM days x WHERE x.d = t.d AND value >= a AND (value < b OR (i = k AND value <= b))) * 1.0e0 / n AS c
  FROM totals t, shares),
psi AS (SELECT d, n, sum((CASE WHEN c = 0 THEN 1e-4 ELSE c END - CASE WHEN s = 0 THEN 1e-4 ELSE s END)
  * ln(CASE WHEN c = 0 THEN 1e-4 ELSE c END / CASE WHEN s = 0 THEN 1e-4 ELSE s END)) AS p FROM cells GROUP BY d, n)
SELECT strftime(d, '%Y-%m-%d %H:%M:%S.%f') AS window_start, 'value' AS "column", n, {_r('p')} AS psi,
  CASE WHEN p >= 0.25 THEN 'significant' WHEN p >= 0.1 THEN 'moderate' ELSE 'stable' END AS drift_status FROM psi
"""

_LINE_PROFILE = _union(
    [
        f"""SELECT '{c}' AS "column", count(*) AS total_count, count(*) - count({c}) AS missing_count, {_r(f'avg({c})') if n else 'CAST(NULL AS DOUBLE)'} AS mean,
  {_r(f'stddev_samp({c})') if n else 'CAST(NULL AS DOUBLE)'} AS std, {_r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)') if n else 'CAST(NULL AS DOUBLE)'} AS median,
  {_r(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)') if n else 'CAST(NULL AS DOUBLE)'} AS q1, {_r(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)') if n else 'CAST(NULL AS DOUBLE)'} AS q3,
  true AS unique_close FROM lineitem"""
        for c, n in [(c, True) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]
        + [(c, False) for c in ("l_returnflag", "l_linestatus", "l_shipdate")]
    ]
)

ORACLES |= {
    "profile_approx_distinct": _LINE_PROFILE,
    "profile_exact_range": """SELECT 'big' AS "column", CAST(min(9007199254740993 + o_orderkey) AS VARCHAR) AS min_exact, CAST(max(9007199254740993 + o_orderkey) AS VARCHAR) AS max_exact FROM orders
UNION ALL SELECT 'money', CAST(min(CAST(o_totalprice AS DECIMAL(24, 2)) * 100000000000000) AS VARCHAR), CAST(max(CAST(o_totalprice AS DECIMAL(24, 2)) * 100000000000000) AS VARCHAR) FROM orders
UNION ALL SELECT 'o_custkey', CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR) FROM orders""",
    "profile_merged_states": _states_sql(False),
    "profile_states_by_day": _states_sql(True),
    "profile_merged_estimates": """SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'is_large', 'props', 'value']) AS "column", true AS close""",
    "duplicate_summary": _duplicates_sql(_COUNTED),
    "duplicate_whole_rows": _duplicates_sql(
        f"WITH e AS (SELECT * FROM {_rel('dirty_events')} t) SELECT count(*) AS copies FROM (SELECT * FROM e UNION ALL SELECT * FROM e WHERE event_id % 7 = 0 "
        "UNION ALL SELECT * FROM e WHERE event_id % 21 = 0) GROUP BY event_id, ts, user_id, event_type, value, is_large, props"
    ),
    "duplicate_groups": f"SELECT l_returnflag, {_r('l_quantity')} AS l_quantity, {_r('l_discount')} AS l_discount, {_r('l_tax')} AS l_tax, copies FROM ({_COUNTED}) WHERE copies > 1",
    "duplicate_members": f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, {_r('l_quantity')} AS l_quantity, {_r('l_discount')} AS l_discount,
  {_r('l_tax')} AS l_tax, copies FROM (SELECT *, count(*) OVER (PARTITION BY {_GROUP}) AS copies FROM lineitem) WHERE copies > 1""",
    "canonical_spelling": _spelling_sql(),
    "top_categories_documents": _union([_categories("text"), _categories("lang"), _categories("source")]),
    "constraints_rule_table": _rule_sql(),
    "rows_rule_table": f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM lineitem WHERE {_BAD_PART}",
    "correlation_wide": _wide_sql(),
    "stream_window_profile": _hours_sql(),
    "stream_window_drift": _DRIFT_SQL,
    "sample_exploded": f"SELECT least({SEED_ROWS}, 10 * count(*)) AS sampled, least({SEED_ROWS}, 10 * count(*)) AS distinct_rows, true AS unbiased FROM orders",
}
