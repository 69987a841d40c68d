"""Schema classification and the missing-value rule.

NaN counts as missing, like NULL. Spark treats NaN as a value, so every plan
starts from :func:`clean`, which turns NaN of float and double columns to NULL.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TEXT = (T.StringType, T.VarcharType, T.CharType)
INSTANT = (T.TimestampType, T.TimestampNTZType, T.DateType)


def family_of(dtype: T.DataType) -> str:
    """The statistics a column gets: numeric, boolean, text, datetime or other."""
    if isinstance(dtype, INTEGRAL + FLOATING + (T.DecimalType,)):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, TEXT):
        return "text"
    if isinstance(dtype, INSTANT):
        return "datetime"
    return "other"


# The coarse class used when columns are counted by type.
CATEGORY = {
    "numeric": "numeric",
    "text": "categorical",
    "datetime": "datetime",
    "boolean": "boolean",
    "other": "other",
}


@dataclass(frozen=True)
class ColumnInfo:
    ordinal: int
    name: str
    dtype: str
    type: T.DataType
    family: str


def ident(name: str) -> str:
    """A column name as SQL text; survives dots and back-ticks."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(ident(name))


def literal(value: Any) -> str:
    """A Python value as SQL text. Infinities and NaN keep a non-nullable type."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"{value}L" if abs(value) > 2**31 - 1 else str(value)
    if isinstance(value, float):
        if math.isinf(value) or math.isnan(value):
            return f"coalesce(double('{value}'), 0D)"
        return f"{value!r}D"
    text = "".join(c if c.isalnum() or c in " _-.:/" else f"\\U{ord(c):08x}" for c in str(value))
    return f"'{text}'"


def literal_frame(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: str) -> DataFrame:
    """A few driver-side rows as a local relation: no task, no Python worker.

    ``schema`` is a list of ``name type`` pairs.
    """
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    cells = ", ".join(f"({', '.join(literal(x) for x in row)})" for row in rows)
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    typed = ", ".join(f"cast(c{i} AS {t}) AS {ident(n)}" for i, (n, t) in enumerate(fields))
    return spark.sql(f"SELECT {typed} FROM VALUES {cells} AS t({names})")


def describe_columns(df: DataFrame, columns: list[str] | None = None) -> list[ColumnInfo]:
    """Name, type and family of every column, in schema order."""
    infos = [
        ColumnInfo(i, f.name, f.dataType.simpleString(), f.dataType, family_of(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]
    if columns is None:
        return infos
    return [c for c in infos if c.name in set(columns)]


def clean(info: ColumnInfo) -> str:
    """SQL text of the column with NaN turned to NULL (floating types only)."""
    name = ident(info.name)
    if isinstance(info.type, FLOATING):
        return f"nanvl({name}, cast(NULL AS {info.dtype}))"
    return name


def as_double(info: ColumnInfo) -> str:
    """SQL text of a numeric or boolean column as double, missing as NULL."""
    if info.family == "boolean":
        return f"cast(cast({ident(info.name)} AS int) AS double)"
    return f"cast({clean(info)} AS double)"


def without(value: str, excluded: Sequence[Any]) -> str:
    """SQL text of a double value that is NULL where it is one of ``excluded``."""
    numbers = numeric_values(excluded)
    if not numbers:
        return value
    return f"CASE WHEN {value} NOT IN ({', '.join(literal(float(x)) for x in numbers)}) THEN {value} END"


def numeric_values(excluded: Sequence[Any]) -> list[Any]:
    """The entries of a list of mixed kinds that a numeric column can hold."""
    kinds = (int, float, decimal.Decimal)
    return [x for x in excluded if isinstance(x, kinds) and not isinstance(x, bool) and x == x]


def text_values(excluded: Sequence[Any]) -> list[str]:
    """The entries of a list of mixed kinds that a text column can hold."""
    return [x for x in excluded if isinstance(x, str)]


def numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[ColumnInfo]:
    """Numeric columns proper: booleans are not among them."""
    return [c for c in describe_columns(df, columns) if c.family == "numeric"]


def schema_frame(spark: SparkSession, infos: list[ColumnInfo]) -> DataFrame:
    """One row per column: ``ordinal, column, dtype, family``."""
    return literal_frame(
        spark,
        [(c.ordinal, c.name, c.dtype, c.family) for c in infos],
        "ordinal int, column string, dtype string, family string",
    )


def require(df: DataFrame, column: str) -> ColumnInfo:
    for info in describe_columns(df):
        if info.name == column:
            return info
    raise ValueError(f"column {column!r} is not in the table")
