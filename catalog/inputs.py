"""The given tables, and dirty versions derived from them the same way in both engines.

The tables carry no missing values, spelling variants or sentinels, so those
are planted by rule over whole tables. In the Spark version half of the planted
gaps are NaN, which must count as missing; SQL writes NULL for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-15 00:00:00"
SPLIT = "2024-01-16 00:00:00"
ORDER_SPLIT = "1998-05-01 00:00:00"
SENTINEL = 9999.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ORDERS = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 14 = 0 THEN CAST(NULL AS DOUBLE)
            WHEN o_orderkey % 7 = 0 THEN {nan} ELSE o_totalprice END AS o_totalprice,
       o_orderdate,
       CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM {source}
"""

_EVENTS = """
SELECT event_id, ts, user_id,
       CASE WHEN event_id % 10 = 0 THEN upper(event_type)
            WHEN event_id % 10 = 1 THEN concat(' ', event_type)
            ELSE event_type END AS event_type,
       CASE WHEN event_id % 50 = 0 THEN 9999.0e0
            WHEN event_id % 9 = 0 THEN {nan} ELSE value END AS value,
       value > 50 AS is_large, props
FROM {source}
"""

_DATES = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 11 = 0 THEN 'n/a'
            WHEN o_orderkey % 2 = 0 THEN {dash} ELSE {slash} END AS order_date,
       {iso} AS iso_date
FROM {source}
"""

# Rows before the split are the reference, the rest, shifted, is the current side.
_DRIFT = """
SELECT event_id, ts, user_id, event_type,
       CASE WHEN ts >= {split} THEN value * 1.2e0 + 10 ELSE value END AS value,
       CASE WHEN ts >= {split} THEN value > 30 ELSE value > 50 END AS is_large
FROM {source}
"""

SQL = {
    "dirty_orders": _ORDERS.format(nan="NULL", source="orders"),
    "dirty_events": _EVENTS.format(nan="NULL", source="events"),
    "order_dates": _DATES.format(
        dash="strftime(o_orderdate, '%Y-%m-%d')",
        slash="strftime(o_orderdate, '%Y/%m/%d')",
        iso="strftime(o_orderdate, '%Y-%m-%d')",
        source="orders",
    ),
    "drifted": _DRIFT.format(split=f"TIMESTAMP '{SPLIT}'", source="events"),
}


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _ORDERS.format(nan="double('NaN')", source="{t}")
    return spark.sql(text, t=table(spark, sf_dir, "orders"))


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _EVENTS.format(nan="double('NaN')", source="{t}")
    return spark.sql(text, t=table(spark, sf_dir, "events"))


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _DATES.format(
        dash="date_format(o_orderdate, 'yyyy-MM-dd')",
        slash="date_format(o_orderdate, 'yyyy/MM/dd')",
        iso="date_format(o_orderdate, 'yyyy-MM-dd')",
        source="{t}",
    )
    return spark.sql(text, t=table(spark, sf_dir, "orders"))


def drift_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    split = f"TIMESTAMP_NTZ '{SPLIT}'"
    whole = spark.sql(_DRIFT.format(split=split, source="{t}"), t=table(spark, sf_dir, "events"))
    return whole.filter(f"ts < {split}"), whole.filter(f"ts >= {split}")


def order_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    split = f"TIMESTAMP_NTZ '{ORDER_SPLIT}'"
    orders = dirty_orders(spark, sf_dir)
    return orders.filter(f"o_orderdate < {split}"), orders.filter(f"o_orderdate >= {split}")
