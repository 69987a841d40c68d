"""Readers and writers by file format, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import warnings
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import ident, literal
from plumbline.operators.sampling import sample_rows

# File name endings per format.
EXTENSIONS = {
    ".csv": "csv",
    ".json": "json",
    ".jsonl": "jsonl",
    ".ndjson": "jsonl",
    ".parquet": "parquet",
    ".pq": "parquet",
    ".orc": "orc",
}


# Cells that stand for a missing value in a CSV file.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Stands for a quoted empty cell while a file is read; a private-use character.
_EMPTY = "\ue001"

# What a cell must be for its column to get a type, in the order of preference.
_TYPE_TESTS = {
    "bigint": "{x} RLIKE '^[+-]?[0-9]+$' AND try_cast({x} AS bigint) IS NOT NULL",
    "double": "{x} RLIKE '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' OR lower({x}) RLIKE '^[+-]?inf(inity)?$'",
    "boolean": "lower({x}) IN ('true', 'false')",
    "date": "{x} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' AND try_cast({x} AS date) IS NOT NULL",
    "timestamp": "{x} RLIKE '^[0-9]{{4}}-' AND try_cast({x} AS timestamp) IS NOT NULL",
}


def format_of(path: str) -> str:
    """The format a path's ending stands for, CSV when it is unknown."""
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending in (".xls", ".xlsx"):
        raise ValueError("spreadsheets have no distributed reader: convert the file first")
    if ending not in EXTENSIONS:
        warnings.warn(f"unknown file ending {ending!r}, reading as CSV", stacklevel=3)
    return EXTENSIONS.get(ending, "csv")


def load_table(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    schema: T.StructType | str | None = None,
    missing: Sequence[str] = MISSING_MARKERS,
    multiline: bool = True,
    dates: bool = False,
) -> DataFrame:
    """Read a file or folder; ``format`` wins over the path's ending.

    ``json`` is an array of records, one record, or one record per line: the
    first characters decide. Only lines split. CSV cells that are one of the
    ``missing`` markers are NULL in every column, and without a ``schema`` each
    column's type is settled by one pass over all its cells; dates stay text
    unless ``dates``. Quoted CSV cells may hold line breaks, which keeps a file
    in one task: turn ``multiline`` off for large files without any. A ``schema``
    spares the pass over the data.
    """
    kind = format or format_of(path)
    if kind == "csv":
        return _load_csv(spark, path, schema, missing, multiline, dates)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "json":
        return reader.json(path, multiLine=not _is_json_lines(spark, path))
    if kind == "jsonl":
        return reader.json(path)
    return reader.format(kind).load(path)


def _is_json_lines(spark: SparkSession, path: str) -> bool:
    """True if the first line that is not blank is a whole record."""
    line = spark.read.text(path).filter("trim(value) <> ''")
    ends = line.selectExpr("left(ltrim(value), 1) AS head", "right(rtrim(value), 1) AS tail").first()
    return ends is None or (ends["head"], ends["tail"]) == ("{", "}")


def _load_csv(spark, path, schema, missing, multiline, dates) -> DataFrame:
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multiline, "emptyValue": _EMPTY}
    if schema is not None:
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
        raw = _with_empty(spark.read.schema(text).csv(path, **options))
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        return raw.selectExpr(*[_typed(c, kinds[c], missing) for c in raw.columns])
    raw = _with_empty(spark.read.csv(path, **options))
    if not raw.columns:
        return raw
    tests = _TYPE_TESTS if dates else {k: v for k, v in _TYPE_TESTS.items() if k not in ("date", "timestamp")}
    aggs = []
    for i, c in enumerate(raw.columns):
        cell = _present(c, missing)
        aggs.append(F.expr(f"count({cell}) AS n{i}"))
        aggs += [F.expr(f"count_if({test.format(x=f'trim({cell})')}) AS {kind}{i}") for kind, test in tests.items()]
    found = raw.agg(*aggs).first()
    kinds = [
        "double" if not found[f"n{i}"] else next((k for k in tests if found[f"{k}{i}"] == found[f"n{i}"]), "string")
        for i in range(len(raw.columns))
    ]
    return raw.selectExpr(*[_typed(c, k, missing) for c, k in zip(raw.columns, kinds)])


def _with_empty(raw: DataFrame) -> DataFrame:
    """Quoted cells without content as empty texts; the reader alone takes them for missing."""
    cells = [f"CASE WHEN {ident(c)} = {literal(_EMPTY)} THEN '' ELSE {ident(c)} END AS {ident(c)}" for c in raw.columns]
    return raw.selectExpr(*cells)


def _present(column: str, missing: Sequence[str]) -> str:
    """SQL text of a CSV cell, NULL where it is a marker."""
    if not missing:
        return ident(column)
    return f"CASE WHEN {ident(column)} NOT IN ({', '.join(map(literal, missing))}) THEN {ident(column)} END"


def _typed(column: str, kind: str, missing: Sequence[str]) -> str:
    cell = _present(column, missing)
    return f"{cell if kind == 'string' else f'try_cast(trim({cell}) AS {kind})'} AS {ident(column)}"


def as_frame(spark: SparkSession, source: DataFrame | str | Mapping[str, str]) -> DataFrame:
    """Any upstream table: a DataFrame, a catalog table name, or JDBC options."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        return spark.table(source)
    return spark.read.format("jdbc").options(**source).load()


def write_table(df: DataFrame, path: str, format: str | None = None, mode: str = "errorifexists") -> None:
    """Write a folder of part files in the given or implied format.

    What is written can be read back by :func:`load_table`: CSV quotes double,
    blanks at the ends of a cell stay, and JSON keeps its NULL fields. Both
    endings of JSON get a record per line.
    """
    kind = format or format_of(path)
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.csv(
            path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    elif kind in ("json", "jsonl"):
        writer.json(path, ignoreNullFields=False)
    else:
        writer.format(kind).save(path)


def export_analysis(analysis, path: str, format: str = "json", mode: str = "errorifexists") -> None:
    """Write profile, issues and summary under ``path``."""
    for name, frame in (
        ("profile", analysis.profile),
        ("issues", analysis.issues),
        ("summary", analysis.summary()),
    ):
        write_table(frame, f"{path.rstrip('/')}/{name}", format, mode)


def sample_large_file(
    spark: SparkSession,
    path: str,
    n: int = 1000,
    seed: int = 42,
    format: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Exactly ``n`` rows of a large file, from all of it; unreadable input warns and is empty."""
    try:
        found = sample_rows(load_table(spark, path, format, schema), n, seed).persist()
        found.count()  # drawn once; a file that cannot be read fails here
        return found
    except (PySparkException, Py4JError) as error:
        warnings.warn(f"cannot sample {path}: {error}", stacklevel=2)
        return spark.createDataFrame([], T.StructType([]))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return os.path.join(tempfile.gettempdir(), "plumbline-shared")
