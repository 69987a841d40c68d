"""Token ids of documents, written in doc_id order to files and read back.

A file is a Parquet file of segments (see ``rans``), so it is written through
Spark's committer and survives lost executors. Rows of a segment: ``shard`` and
``segment`` (ascending in doc_id order), the ids and lengths of its documents,
``n_ids``, the ids ``before`` it in the shard, and the coded ``payload``. A shard is one range of doc_ids; documents
never span segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import scratch, ship
from plumbline.llm.tokens import default_vocabulary, encoded_batches

END_ID = 0
#: A segment is closed by the document that brings it to so many ids.
SEGMENT_IDS = 2_000_000
FILE_SCHEMA = "shard int, segment int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, before bigint, payload binary"
READ_SCHEMA = "shard int, doc_id bigint, start_in_shard bigint, n_tokens bigint, ids binary"


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole ``text``, append ``END_ID``, and write files in ascending doc_id order.

    A null or empty text is the end id alone. Null doc_ids come first; rows with
    equal doc_ids are documents of their own, ordered by their ids' checksum and
    length; an empty table gives files without rows; other columns are not read.
    One shuffle, by ranges of doc_id; a task holds one segment.
    """
    ship(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()

    def segments(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from plumbline.llm.rans import encode_segment

        shard, number = TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()
        keys, parts, held, before = [], [], 0, 0

        def closed():
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.record_batch(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "segment": pa.array([number], pa.int32()),
                    "doc_ids": pa.array([keys], pa.list_(pa.int64())),
                    "lengths": pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int64())),
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "before": pa.array([before], pa.int64()),
                    "payload": pa.array([encode_segment(ids)], pa.binary()),
                }
            )

        for rows, ids in encoded_batches(batches, vocabulary):
            for key, own in zip(rows.column("doc_id").to_pylist(), ids, strict=True):
                keys.append(key)
                parts.append(own + end)
                held += len(own) // 4 + 1
                if held >= segment_ids:
                    yield closed()
                    keys, parts, held, before, number = [], [], 0, before + held, number + 1
        if keys:
            yield closed()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), F.length("text"))
    ordered.mapInArrow(segments, FILE_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids`` (little-endian uint32)."""
    ship(spark)

    def documents(batches):
        import numpy as np
        import pyarrow as pa

        from plumbline.llm.rans import decode_segment

        for batch in batches:
            for row in batch.to_pylist():
                raw = decode_segment(row["payload"]).astype("<u4").tobytes()
                ends = np.cumsum(row["lengths"])
                begins = ends - row["lengths"]
                yield pa.record_batch(
                    {
                        "shard": pa.array([row["shard"]] * len(ends), pa.int32()),
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "start_in_shard": pa.array(begins + row["before"], pa.int64()),
                        "n_tokens": pa.array(row["lengths"], pa.int64()),
                        "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)], pa.binary()),
                    }
                )

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row per shard, as many as the tasks that wrote.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).selectExpr(
        "shard", "coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shard_start"
    )
    rows = files.select("shard", "doc_ids", "lengths", "payload", "before").mapInArrow(documents, READ_SCHEMA)
    return rows.join(F.broadcast(shards), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids"
    )


def token_rows(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the ids to the shared folder, read them back, and give each document's digest."""
    spark = docs.sparkSession
    path = scratch(spark, "token-ids")
    write_ids(docs, path, vocabulary)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
