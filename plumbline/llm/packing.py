"""Packing documents into sequences by best-fit decreasing.

A document's ids are cut into full windows, which are sequences of their own, and
a rest that is shorter than a window. The rests of a block of documents are
placed longest first, each into the open sequence with the least room that still
holds it; a segment tree indexed by remaining room finds it. Only lengths are
placed, so a block is some 200 bytes a piece, besides the ids where they are wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.llm.shared import ship
from plumbline.llm.token_store import END_ID
from plumbline.llm.tokens import default_vocabulary, encoded_batches

WINDOW = 1024
#: Rests that are placed together, with and without their ids; a task goes through its documents block by block.
BLOCK_RESTS = {False: 20_000, True: 200_000}
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
)
DIGEST_SCHEMA = SCHEMA.replace("ids binary", "ids_crc32 bigint")


class RoomTree:
    """Counts of open sequences by remaining room, as a segment tree over the rooms 0 to ``window``."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def tightest(self, need: int) -> int:
        """The smallest room of at least ``need`` that an open sequence has, -1 where none has."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length, placed longest first into the tightest open sequence."""
    tree, out, n = RoomTree(window), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        room = tree.tightest(need)
        if room < 0:
            sequence, room, n = n, window, n + 1
        else:
            sequence = tree.take(room)
        out[i] = (sequence, window - room)
        if room > need:
            tree.put(room - need, sequence)
    return out


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, digest: bool = False) -> DataFrame:
    """One row per piece of a document's ids (whole text, then ``END_ID``) and where it lies.

    ``start`` is the piece's place in its document, ``sequence_id`` and ``offset``
    its place in the output; each id lies in one piece and offsets have no gaps.
    ``ids`` are little-endian uint32, or with ``digest`` their CRC-32. A null or
    empty text is the end id alone; repeated rows are packed one by one; an empty
    table gives no rows; other columns are not read. No shuffle: sequences are
    filled within blocks of ``BLOCK_RESTS`` rests of a task, in the scan's order.
    """
    ship(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()

    def pieces(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        end = np.array([END_ID], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rests: list[tuple] = []
        value = (lambda b: zlib.crc32(b)) if digest else bytes

        def rows(columns):
            kinds = [pa.binary() if n == "ids" and not digest else pa.int64() for n in names]
            out = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.record_batch(out, ["ids_crc32" if n == "ids" and digest else n for n in names])

        def placed():
            nonlocal first
            where = best_fit([r[2] for r in rests], window)
            out = [(*r, first + s, o) for r, (s, o) in zip(rests, where, strict=True)]
            first += 1 + max((s for s, _ in where), default=-1)
            rests.clear()
            for at in range(0, len(out), 10_000):
                yield rows(list(zip(*out[at : at + 10_000], strict=True)))

        for batch, ids in encoded_batches(batches, vocabulary):
            full = []
            for key, own in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                own += end
                n = len(own) // 4
                for a in range(0, n, window):
                    k = min(window, n - a)
                    piece = (key, a, k, value(own[4 * a : 4 * (a + k)]), n)
                    if k == window:
                        full.append((*piece, first, 0))
                        first += 1
                    else:
                        rests.append(piece)
            if full:
                yield rows(list(zip(*full, strict=True)))
            if len(rests) >= BLOCK_RESTS[digest]:
                yield from placed()
        if rests:
            yield from placed()

    rows = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text")
    return rows.mapInArrow(pieces, DIGEST_SCHEMA if digest else SCHEMA)


def packed_rows(docs: DataFrame) -> DataFrame:
    return pack(docs, digest=True)
