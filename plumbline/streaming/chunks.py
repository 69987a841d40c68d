"""A fixed-size uniform sample of files that arrive chunk by chunk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.sampling import DRAW


def read_chunks(
    spark: SparkSession, folder: str, schema: T.StructType | str, format: str = "csv", files: int = 1
) -> DataFrame:
    """A stream over the files of a folder, ``files`` of them per chunk."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if format == "csv":
        reader = reader.option("header", True)
    return reader.format(format).load(folder)


def sample_chunks(chunks: DataFrame, folder: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """Run the stream over what is there and return ``n`` rows sampled from all chunks.

    Each row draws a number; the sample is the ``n`` smallest draws so far. A
    chunk writes the sample after it as its own version under ``folder``, which
    must be shared: a chunk that is run again reads the version before it and
    overwrites its own, so a lost executor or a restart changes nothing.
    """
    kept = f"{folder.rstrip('/')}/sample"

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        drawn = batch.withColumn(DRAW, F.rand(seed + batch_id)).orderBy(DRAW).limit(n)
        if batch_id > 0:
            drawn = drawn.unionByName(session.read.parquet(f"{kept}/version={batch_id - 1}"))
            drawn = drawn.orderBy(DRAW).limit(n)
        drawn.write.mode("overwrite").parquet(f"{kept}/version={batch_id}")

    query = (
        chunks.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{folder.rstrip('/')}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    try:
        versions = chunks.sparkSession.read.parquet(kept)
    except AnalysisException:  # no chunk came
        return chunks.sparkSession.createDataFrame([], chunks.schema)
    last = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == last).drop("version", DRAW)
