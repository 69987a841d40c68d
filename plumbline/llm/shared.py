"""What the text operators share: written tables, module shipping, fixed patterns."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 pattern of the white space between words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = os.path.join(tempfile.gettempdir(), "plumbline-scratch")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline_modules.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._plumbline_shipped = True


def shielded(docs: DataFrame, helpers: tuple[str, ...], work) -> DataFrame:
    """``work(docs)``, whose helper columns have these names, with input columns of the same names put aside."""
    clash = {c: f"{c}_of_input_{i}" for i, c in enumerate(docs.columns) if c.lower() in helpers}
    if not clash:
        return work(docs)
    return work(docs.withColumnsRenamed(clash)).withColumnsRenamed({v: k for k, v in clash.items()})


def words_of(text: Column) -> Column:
    """The maximal runs of other than white space."""
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where ``use`` has lambdas that refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
