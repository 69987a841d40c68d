"""Removal of byte strings that an earlier document holds too, through suffix arrays.

Every window of ``LENGTH`` bytes is judged at its anchor: the place in it where a
hash of ``ANCHOR`` bytes is least, which depends on nothing but the window, so
equal windows have equal anchors. Only anchors whose hash is in two documents or
more can matter. Their contexts (the bytes that the windows of the anchor span)
go to the bucket of the hash, equal contexts of a batch as one with their least
doc_id. There a suffix array, built by linear grouping over eight-byte symbols,
orders what follows the anchors and, reversed, what precedes them; runs in the
two orders give the equal windows and the least doc_id of each.

Texts are kept in batches, a table bucketed by batch, so that the answers come
back to the texts without shuffling those again.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import ship, written
from plumbline.llm.suffixes import suffix_array

LENGTH = 50
ANCHOR = 24
SPAN = LENGTH - ANCHOR  # a window holds SPAN + 1 places for an anchor
#: Bytes of text in a batch, and of text whose anchors a bucket holds on average.
BATCH_BYTES = 4_000_000
BUCKET_BYTES = 8_000_000
#: Bytes whose anchors are found at once, and contexts that share a suffix array.
CHUNK = 1 << 18
CONTEXTS = 20_000
#: Contexts of a bucket that are looked at together.
RANGE = 50_000
NO_DOC = np.iinfo(np.int64).max

_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CONTEXT = SPAN + LENGTH
#: A context as a record: hash (48 bits, big-endian), most and least bytes before the anchor, padded bytes.
_RECORD = 6 + 2 + _CONTEXT


def _hashes(data: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of the ``ANCHOR`` bytes at each place, those at the end being of fewer bytes."""
    padded = np.concatenate([data, np.zeros(ANCHOR, np.uint8)]).astype(np.uint64) + np.uint64(1)
    width, parts = 1, {1: padded}
    while 2 * width <= ANCHOR:
        h, power = parts[width], np.uint64(pow(int(_BASE), width, 1 << 64))
        parts[2 * width] = h[:-width] * power + h[width:]
        width *= 2
    out, done = parts[width], width
    while done < ANCHOR:
        width //= 2
        if done + width <= ANCHOR:
            factor = np.uint64(pow(int(_BASE), width, 1 << 64))
            tail = parts[width]
            out = out[: len(tail) - done] * factor + tail[done : done + len(out)][: len(tail) - done]
            done += width
    out = out[: len(data)]
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return out ^ (out >> np.uint64(29))


class Anchors:
    """The anchors of a batch: ``at``, the most and least bytes of their windows before them, and ``hash`` (48 bits)."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.data = data
        self.ends = np.cumsum(sizes)
        parts = [self._of_windows(a, min(a + CHUNK, len(data))) for a in range(0, len(data), CHUNK)]
        none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
        self.at, self.most, self.least, self.hash = (np.concatenate(x) for x in zip(none, *parts, strict=True))
        self.doc = np.searchsorted(self.ends, self.at, "right")

    def _of_windows(self, begin: int, end: int):
        """The anchors of the windows that begin in [begin, end), in order; a run that goes on is cut there."""
        data = self.data[begin : end + LENGTH]
        h = value = _hashes(data)
        place = np.arange(len(data), dtype=np.int32)
        width = 1
        while width < SPAN + 1 and len(value) > SPAN + 1:
            step = min(width, SPAN + 1 - width)
            less = value[step:] < value[:-step]  # the left one wins ties
            value = np.where(less, value[step:], value[:-step])
            place = np.where(less, place[step:], place[:-step])
            width += step
        if width < SPAN + 1:
            place = place[:0]
        first = np.arange(begin, min(begin + len(place), end))
        end_of = self.ends[np.searchsorted(self.ends, first, "right")] if len(first) else first
        windows = np.flatnonzero(first + LENGTH <= end_of)
        own = place[windows].astype(np.int64)
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(own)) - 1 if len(own) else head
        at = own[head]
        # The hashes of anchors are small, being least ones; mixed again they fill their range evenly.
        even = h[at] * _MIX
        even = (even ^ (even >> np.uint64(32))) * _BASE
        return at + begin, at - windows[head], at - windows[tail], even >> np.uint64(16)

    def distinct(self):
        """(sorted hashes, if it is in several documents, number of each anchor's hash)."""
        hashes, number = np.unique(self.hash, return_inverse=True)
        low = np.full(len(hashes), len(self.ends), np.int64)
        high = np.full(len(hashes), -1, np.int64)
        np.minimum.at(low, number, self.doc)
        np.maximum.at(high, number, self.doc)
        return hashes, low < high, number

    def records(self, own: np.ndarray) -> np.ndarray:
        """The contexts of the anchors ``own`` as rows of bytes."""
        at, most, least = self.at[own], self.most[own], self.least[own]
        out = np.zeros((len(own), _RECORD), np.uint8)
        out[:, :6] = self.hash[own].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
        out[:, 6], out[:, 7] = most, least
        padded = np.concatenate([self.data, np.zeros(LENGTH, np.uint8)])
        k = np.arange(-SPAN, LENGTH)
        for a in range(0, len(own), 10_000):
            cut = slice(a, a + 10_000)
            inside = (k >= -most[cut, None]) & (k < LENGTH - least[cut, None])
            out[cut, 8:] = np.where(inside, padded[np.maximum(at[cut, None] + k, 0)], 0)
        return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash."""
    return ((hashes >> np.uint64(16)).astype(np.int64) * buckets) >> 32


def _orders(texts: np.ndarray) -> np.ndarray:
    """The rank of each row of padded bytes, by the suffix array of all rows' eight-byte symbols."""
    rows, width = texts.shape
    pad = -width % 8
    wide = np.concatenate([texts, np.zeros((rows, pad), np.uint8)], axis=1)
    words = np.ascontiguousarray(wide).view(">u8").astype(np.uint64)
    symbols = np.unique(words, return_inverse=True)[1].reshape(words.shape) + 1
    each = symbols.shape[1] + 1
    text = np.zeros((rows, each), np.int64)  # a zero ends a row
    text[:, :-1] = symbols
    order = np.array(suffix_array(text.reshape(-1).tolist()), np.int64)
    return order[order % each == 0] // each


def least_documents(records: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The least doc_id of each window of distinct contexts that share hashes, (contexts, SPAN + 1) by bytes before."""
    most, least = records[:, 6].astype(np.int64), records[:, 7].astype(np.int64)
    out = np.repeat(docs[:, None], SPAN + 1, axis=1)
    right, left = records[:, 8 + SPAN :], records[:, 8 : 8 + SPAN][:, ::-1]
    by_right, by_left = _orders(np.ascontiguousarray(right)), _orders(np.ascontiguousarray(left))
    group = np.zeros((2, len(records)), np.int64)
    for a in range(SPAN + 1):
        live = (most >= a) & (least <= a)
        for side, order, texts, width in ((0, by_right, right, LENGTH - a), (1, by_left, left, a)):
            own = order[live[order]]
            rows = texts[own, :width]
            new = np.any(rows[1:] != rows[:-1], axis=1) if width else np.zeros(max(0, len(own) - 1), bool)
            group[side, own] = np.concatenate([[0], np.cumsum(new)]) if len(own) else 0
        own = np.flatnonzero(live)
        key = group[0, own] * (len(records) + 1) + group[1, own]
        _, number = np.unique(key, return_inverse=True)
        low = np.full(len(own), NO_DOC)
        np.minimum.at(low, number, docs[own])
        out[own, a] = low[number]
    return out


def _by_hash(records: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """``least_documents`` of records sorted by hash, some ``CONTEXTS`` at a time; those of one hash stay together."""
    out = np.empty((len(records), SPAN + 1), np.int64)
    begin = 0
    while begin < len(records):
        end = min(begin + CONTEXTS, len(records))
        while end < len(records) and (records[end, :6] == records[end - 1, :6]).all():
            end += 1
        out[begin:end] = least_documents(records[begin:end], docs[begin:end])
        begin = end
    return out


def _packed(array: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def _unpacked(data: bytes, kind, width: int | None = None) -> np.ndarray:
    import zstandard

    out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)
    return out if width is None else out.reshape(-1, width)


def _batches(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """The texts in batches, as a table bucketed by batch."""

    def gathered(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number, held, keys, parts = TaskContext.get().partitionId() << 32, 0, [], []

        def closed():
            return pa.record_batch(
                {
                    "batch": pa.array([number], pa.int64()),
                    "doc_ids": pa.array([keys], pa.list_(pa.int64())),
                    "sizes": pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                    "data": pa.array([b"".join(parts)], pa.binary()),
                }
            )

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if keys and held + len(raw) > batch_bytes:
                    yield closed()
                    number, held, keys, parts = number + 1, 0, [], []
                keys.append(key)
                parts.append(raw)
                held += len(raw)
        if keys:
            yield closed()

    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text").mapInArrow(
        gathered, "batch bigint, doc_ids array<bigint>, sizes array<bigint>, data binary"
    )
    name = f"text_batches_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(n, "batch").sortBy("batch").saveAsTable(name)
    return spark.table(name)


def _anchors_of(row) -> Anchors:
    return Anchors(np.frombuffer(row["data"], np.uint8), np.array(row["sizes"], np.int64))


def _by_bucket(buckets: int):
    """Each batch's distinct anchor hashes, cut by bucket."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                hashes, several, _ = _anchors_of(row).distinct()
                edges = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
                six = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                some = np.flatnonzero(np.diff(edges))
                yield pa.record_batch(
                    {
                        "bucket": pa.array(some, pa.int32()),
                        "batch": pa.array([row["batch"]] * len(some), pa.int64()),
                        "hashes": pa.array([six[edges[b] : edges[b + 1]].tobytes() for b in some], pa.binary()),
                        "several": pa.array([np.packbits(several[edges[b] : edges[b + 1]]).tobytes() for b in some], pa.binary()),
                    }
                )

    return cut


def _repeated(pdf):
    """Of one bucket: which hashes of each batch are in two documents or more."""
    import pandas as pd

    parts = []
    for raw in pdf["hashes"]:
        wide = np.zeros((len(raw) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        parts.append(wide.view("<u8").reshape(-1))
    several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8))[: len(p)] for s, p in zip(pdf["several"], parts)]).astype(bool)
    hashes = np.concatenate(parts)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    twice = np.zeros(len(ranked), bool)
    same = ranked[1:] == ranked[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    flag = several.copy()
    flag[order] |= twice
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    flags = [np.packbits(f).tobytes() for f in np.split(flag, cuts)]
    return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "n": [len(p) for p in parts], "flags": flags})


def _marked(row, found: Anchors):
    """The numbers of a batch's anchors whose hash is repeated."""
    hashes, _, number = found.distinct()
    answers = sorted(row["flags"] or [], key=lambda x: x["bucket"])
    flags = [np.unpackbits(np.frombuffer(x["flags"], np.uint8))[: x["n"]] for x in answers]
    flag = np.concatenate(flags).astype(bool) if flags else np.zeros(len(hashes), bool)
    return np.flatnonzero(flag[number])


def _distinct_contexts(row, found: Anchors, own: np.ndarray):
    """(records, least doc_id, number of each anchor's record) of the anchors ``own``."""
    records = found.records(own)
    view = np.ascontiguousarray(records).view(f"V{_RECORD}").reshape(-1)
    _, first, number = np.unique(view, return_index=True, return_inverse=True)
    docs = np.array([NO_DOC if d is None else d for d in row["doc_ids"]], np.int64)
    low = np.full(len(first), NO_DOC)
    np.minimum.at(low, number, docs[found.doc[own]])
    return records[first], low, number


def _contexts(buckets: int):
    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                found = _anchors_of(row)
                records, low, _ = _distinct_contexts(row, found, _marked(row, found))
                bucket = bucket_of(_hash_of(records), buckets)
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(edges))
                yield pa.record_batch(
                    {
                        "bucket": pa.array(some, pa.int32()),
                        "batch": pa.array([row["batch"]] * len(some), pa.int64()),
                        "records": pa.array([_packed(records[edges[b] : edges[b + 1]]) for b in some], pa.binary()),
                        "docs": pa.array([_packed(low[edges[b] : edges[b + 1]]) for b in some], pa.binary()),
                    }
                )

    return cut


def _hash_of(records: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(records), 8), np.uint8)
    wide[:, 2:] = records[:, :6]
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def _least_by_window(records: np.ndarray, docs: np.ndarray):
    """Per record the least doc_id of all its windows, a row number where they differ, and those rows."""
    view = np.ascontiguousarray(records).view(f"V{_RECORD}").reshape(-1)
    _, first, number = np.unique(view, return_index=True, return_inverse=True)
    low = np.full(len(first), NO_DOC)
    np.minimum.at(low, number, docs)
    distinct = records[first]
    same = np.all(distinct[1:, :6] == distinct[:-1, :6], axis=1)
    shared = np.zeros(len(distinct), bool)
    shared[1:] |= same
    shared[:-1] |= same
    own = np.flatnonzero(shared)
    windows = _by_hash(distinct[own], low[own])
    a = np.arange(SPAN + 1)
    live = (a <= distinct[own, 6:7]) & (a >= distinct[own, 7:8])
    lowest = np.where(live, windows, NO_DOC).min(axis=1, initial=NO_DOC)
    differ = np.any(live & (windows != lowest[:, None]), axis=1)
    low[own] = lowest
    row_of = np.full(len(distinct), -1)
    row_of[own[differ]] = np.arange(int(differ.sum()))
    return low[number], row_of[number], windows[differ]


def _answers(pdf):
    """Of one bucket: for each batch's contexts the least doc_id of all their windows, or of each where they differ.

    A batch's contexts come sorted by hash, so the bucket is gone through in ranges of some ``RANGE`` contexts.
    """
    import pandas as pd

    parts = [_unpacked(x, np.uint8, _RECORD) for x in pdf["records"]]
    docs = [_unpacked(x, np.int64) for x in pdf["docs"]]
    hashes = [_hash_of(p) for p in parts]
    every = np.sort(np.concatenate(hashes))
    cuts = np.unique(every[RANGE::RANGE])
    edges = [np.concatenate([[0], np.searchsorted(h, cuts), [len(h)]]).astype(np.int64) for h in hashes]
    low = [np.empty(len(h), np.int64) for h in hashes]
    where: list[list] = [[] for _ in parts]
    windows: list[list] = [[] for _ in parts]
    for k in range(len(cuts) + 1):
        spans = [(e[k], e[k + 1]) for e in edges]
        least, row, rows = _least_by_window(
            np.concatenate([p[i:j] for p, (i, j) in zip(parts, spans, strict=True)]),
            np.concatenate([d[i:j] for d, (i, j) in zip(docs, spans, strict=True)]),
        )
        at = 0
        for n, (i, j) in enumerate(spans):
            own = row[at : at + j - i]
            low[n][i:j] = least[at : at + j - i]
            mixed = np.flatnonzero(own >= 0)
            where[n].append((mixed + i).astype(np.int32))
            windows[n].append(rows[own[mixed]])
            at += j - i
    return pd.DataFrame(
        {
            "batch": pdf["batch"],
            "bucket": pdf["bucket"],
            "low": [_packed(x) for x in low],
            "where": [_packed(np.concatenate(x)) for x in where],
            "windows": [_packed(np.concatenate(x)) for x in windows],
        }
    )


def _covered(row, found: Anchors) -> np.ndarray:
    """Which bytes of a batch go."""
    cover = np.zeros(len(found.data) + 1, np.int32)
    own = _marked(row, found)
    if len(own):
        _, _, number = _distinct_contexts(row, found, own)
        low, matrix, of = [], [], np.full(0, -1)
        rows = 0
        for x in sorted(row["answers"] or [], key=lambda x: x["bucket"]):
            part = _unpacked(x["low"], np.int64)
            at = np.full(len(part), -1)
            where = _unpacked(x["where"], np.int32)
            at[where] = np.arange(len(where)) + rows
            rows += len(where)
            low.append(part)
            of = np.concatenate([of, at])
            matrix.append(_unpacked(x["windows"], np.int64, SPAN + 1))
        low, matrix = np.concatenate(low), np.concatenate(matrix)
        docs = np.array([-1 if d is None else d for d in row["doc_ids"]], np.int64)[found.doc[own]]
        at, most, least = found.at[own], found.most[own], found.least[own]
        whole = (of[number] < 0) & (low[number] < docs)
        np.add.at(cover, (at - most)[whole], 1)
        np.add.at(cover, (at - least + LENGTH)[whole], -1)
        mixed = np.flatnonzero((of[number] >= 0) & (low[number] < docs))
        for a in range(SPAN + 1):
            gone = mixed[(most[mixed] >= a) & (least[mixed] <= a)]
            gone = gone[matrix[of[number[gone]], a] < docs[gone]]
            np.add.at(cover, at[gone] - a, 1)
            np.add.at(cover, at[gone] - a + LENGTH, -1)
    return np.cumsum(cover)[:-1] > 0


_OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, spans array<bigint>"


def _results(batches):
    """Each document's numbers, what is left of it, and the removed spans as begin, end, begin, end ..."""
    import hashlib

    import pyarrow as pa

    names = [c.split()[0] for c in _OUT.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.int64())]
    for batch in batches:
        for row in batch.to_pylist():
            found = _anchors_of(row)
            gone = _covered(row, found)
            out, begin = [], 0
            for key, end in zip(row["doc_ids"], found.ends.tolist(), strict=True):
                own = gone[begin:end]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                kept = found.data[begin:end][~own].tobytes()
                out.append((key, end - begin, int(own.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept, edges.tolist()))
                begin = end
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def remove_repeated(docs: DataFrame, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: its bytes without those of ``LENGTH``-byte strings that a smaller doc_id has too.

    Columns: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``,
    ``kept`` and ``spans`` (begins and ends). Strings lie within one document and
    are judged on the input. A null text is empty, and texts under ``LENGTH``
    bytes lose nothing. Rows of one doc_id do not count against each other; a row
    with a null doc_id neither loses nor takes. An empty table gives no rows;
    other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    texts = _batches(docs, batch_bytes)
    total = texts.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(n, -(-total // bucket_bytes))
    hashes = texts.mapInArrow(_by_bucket(buckets), "bucket int, batch bigint, hashes binary, several binary")
    flags = hashes.groupBy("bucket").applyInPandas(_repeated, "batch bigint, bucket int, n int, flags binary")
    flags = written(
        flags.groupBy("batch").agg(F.collect_list(F.struct("bucket", "n", "flags")).alias("flags")), "repeated"
    )
    marked = texts.join(flags.hint("merge"), "batch", "left")
    contexts = marked.mapInArrow(_contexts(buckets), "bucket int, batch bigint, records binary, docs binary")
    answers = contexts.groupBy("bucket").applyInPandas(
        _answers, "batch bigint, bucket int, low binary, where binary, windows binary"
    )
    answers = written(
        answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "low", "where", "windows")).alias("answers")),
        "answers",
    )
    return marked.join(answers.hint("merge"), "batch", "left").mapInArrow(_results, _OUT)


def substring_rows(docs: DataFrame) -> DataFrame:
    return remove_repeated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
