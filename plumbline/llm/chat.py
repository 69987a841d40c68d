"""Collapse of cumulative chat logs: only conversations that prefix no longer one are rendered.

A log that is saved after every turn holds each conversation many times over. Each
turn gets the rolling hash of its conversation up to there; a conversation whose
last hash is also that of an inner turn of another one is a prefix of it and goes
by an anti-join, and of equal ones the least id stays. Turns are sorted by range,
so a conversation of any length may lie in many partitions; the rolling hash is a
sum that joins over their borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import ship, written

#: Turns in one rendered text; a longer conversation gives several parts.
PART_TURNS = 256
PRIME = (1 << 61) - 1
BASES = (911382323, 972663749)

_LOCAL = "conv_id bigint, turn bigint, role string, text string, part int, at bigint, h1 bigint, h2 bigint, last boolean"
_EDGES = "part int, first bigint, conv_id bigint, n bigint, h1 bigint, h2 bigint"


def _local_hashes(batches):
    """Numbers the turns and rolls the hashes of each conversation's run in this partition."""
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [c.split()[0] for c in _LOCAL.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    before = key = None
    at = h1 = h2 = 0
    p1 = p2 = 1
    waiting: tuple | None = None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            conv, turn, role, text, a, b = row
            if before == (conv, turn, role, text):
                continue
            before = (conv, turn, role, text)
            if waiting:
                out.append((*waiting, conv != key))
            if conv != key:
                key, at, h1, h2, p1, p2 = conv, 0, 0, 0, 1, 1
            at += 1
            h1, h2 = (h1 + (a % PRIME) * p1) % PRIME, (h2 + (b % PRIME) * p2) % PRIME
            p1, p2 = p1 * BASES[0] % PRIME, p2 * BASES[1] % PRIME
            waiting = (conv, turn, role, text, part, at, h1, h2)
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if waiting:
        out = [(*waiting, None)]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _joined(edges) -> list[tuple]:
    """For each partition: its first conversation, what precedes it there, and if its last one goes on."""
    out, carried = [], None
    for i, e in enumerate(edges):
        own = carried if carried and carried[0] == e["first"] else (e["first"], 0, 0, 0)
        goes_on = i + 1 < len(edges) and edges[i + 1]["first"] == e["conv_id"]
        out.append((e["part"], e["first"], own[1], own[2], own[3], goes_on))
        n0, a, b = own[1:] if e["conv_id"] == e["first"] else (0, 0, 0)
        carried = (
            e["conv_id"],
            n0 + e["n"],
            (a + e["h1"] * pow(BASES[0], n0, PRIME)) % PRIME,
            (b + e["h2"] * pow(BASES[1], n0, PRIME)) % PRIME,
        )
    return out


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its number ``at``, the rolling hashes ``h1``, ``h2`` up to it, and if it is the ``last``.

    Turns are ordered by (turn, role, text); equal rows count once; a null role is
    ``unknown`` and a null text empty; rows without a conv_id are in no
    conversation and left out.
    """
    spark = turns.sparkSession
    ship(spark)
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    hashed = rows.withColumn("a", F.xxhash64(F.lit(1), "role", "text")).withColumn("b", F.xxhash64(F.lit(2), "role", "text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = hashed.repartitionByRange(n, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    local = written(ordered.mapInArrow(_local_hashes, _LOCAL), "turns")
    # Two numbers a partition: its first conversation, and its last with that run's hashes.
    edges = local.groupBy("part").agg(
        F.min("conv_id").alias("first"), F.max_by(F.struct("conv_id", F.col("at").alias("n"), "h1", "h2"), F.struct("conv_id", "at")).alias("e")
    ).select("part", "first", "e.*")
    joined = _joined(sorted(edges.collect(), key=lambda r: r["part"]))
    borders = spark.createDataFrame(
        joined, "part int, first bigint, n0 bigint, a bigint, b bigint, goes_on boolean"
    )

    def shifted(batches):
        import pyarrow as pa

        for batch in batches:
            d = batch.to_pydict()
            h1, h2, at = [], [], []
            for i in range(batch.num_rows):
                n0 = d["n0"][i]
                at.append(d["at"][i] + n0)
                h1.append((d["a"][i] + d["h1"][i] * pow(BASES[0], n0, PRIME)) % PRIME if n0 else d["h1"][i])
                h2.append((d["b"][i] + d["h2"][i] * pow(BASES[1], n0, PRIME)) % PRIME if n0 else d["h2"][i])
            keep = batch.select(["conv_id", "turn", "role", "text"])
            yield pa.record_batch([*keep.columns, pa.array(at), pa.array(h1), pa.array(h2), batch.column("last")],
                                  ["conv_id", "turn", "role", "text", "at", "h1", "h2", "last"])

    on = F.broadcast(borders)
    placed = local.join(on, "part").selectExpr(
        "conv_id", "turn", "role", "text", "at", "h1", "h2",
        "CASE WHEN conv_id = first THEN n0 ELSE 0 END AS n0", "a", "b", "coalesce(last, NOT goes_on) AS last",
    )
    return placed.mapInArrow(
        shifted, "conv_id bigint, turn bigint, role string, text string, at bigint, h1 bigint, h2 bigint, last boolean"
    )


def maximal(turns: DataFrame) -> DataFrame:
    """The rows of ``prefixes`` of conversations that prefix no longer one, one of equal ones."""
    rows = written(prefixes(turns), "rolling")
    inner = rows.filter("NOT last").select("at", "h1", "h2").distinct()
    ends = rows.filter("last").groupBy("at", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    kept = ends.join(inner, ["at", "h1", "h2"], "left_anti").select("conv_id")
    return rows.join(kept, "conv_id", "left_semi")


def render(turns: DataFrame) -> DataFrame:
    """Maximal conversations as text: ``conv_id``, ``part``, ``first_turn``, ``n_turns``, ``text``.

    A part holds up to ``PART_TURNS`` turns, so no conversation is gathered whole.
    An empty table gives no rows; other columns are not read.
    """
    segment = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    part = F.floor((F.col("at") - 1) / PART_TURNS).cast("long")
    parts = maximal(turns).groupBy("conv_id", part.alias("part")).agg(
        F.min("at").alias("first"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("at", segment.alias("s")))).alias("s")
    )
    return parts.select(
        "conv_id", "part", (F.col("first") - 1).alias("first_turn"), "n_turns", F.array_join(F.col("s.s"), "").alias("text")
    )


RENDER_SQL = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS at_ FROM turns),
rolled AS (
  SELECT *, at_ = count(*) OVER (PARTITION BY conv_id) AS last_,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY at_) AS prefix_
  FROM numbered),
ends_ AS (SELECT prefix_, min(conv_id) AS conv_id FROM rolled WHERE last_ GROUP BY prefix_),
kept_ AS (SELECT conv_id FROM ends_ WHERE prefix_ NOT IN (SELECT prefix_ FROM rolled WHERE NOT last_))
SELECT conv_id, (at_ - 1) // {PART_TURNS} AS part, min(at_) - 1 AS first_turn, count(*) AS n_turns,
  string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY at_) AS text
FROM numbered WHERE conv_id IN (SELECT conv_id FROM kept_)
GROUP BY conv_id, (at_ - 1) // {PART_TURNS}
"""
