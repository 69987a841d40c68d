"""Web pages as WARC records in seekable Zstandard bundles.

A bundle is one file, ``<name>.warc.zst``: records are grouped into independent
Zstandard frames, and behind the frames stands a skippable frame with the seek
table (compressed size, size and XXH64 of each frame), so any Zstandard tool can
unpack the file and a reader can go to one frame without the others. The index
beside the bundles, a Parquet table, maps a record's id to its bundle, frame,
offset within the unpacked frame and length. A bundle counts only if the index
names it: what a lost task has left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import scratch, ship

#: A frame is closed by the record that brings it to so many bytes, a bundle by the frame that does.
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 32 * 1024 * 1024
#: A payload with at least this share of all pages (and so many copies) is dealt out by page, not by payload.
HOT_SHARE = 1 / 1000
HOT_COPIES = 1000
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = (
    "record_id string, page_id bigint, record_type string, bundle string, frame int, offset bigint, length bigint"
)
RECORD_SCHEMA = (
    "record_id string, page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, payload binary"
)


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    """The same for the same page, payload and copy number, so a repeated task names its records alike."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}:{copy}'.encode()).digest()[:16])}>"


def base32_digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _shown(url: str) -> str:
    """A URL in one header line: what is not printable ASCII is percent-encoded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def made_record(name, page_id, url, digest, n_bytes, payload, refers_to=None) -> bytes:
    """A response with its payload, or a revisit of ``refers_to`` (record id, page id), which keeps the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_shown(url)}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers_to[0]}"]
        if refers_to[1] is not None:
            head.append(f"Refers-To-Page-Id: {refers_to[1]}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {name}\r\nWARC-Date: {DATE}\r\n"
    return f"{head}Content-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def parsed_records(buffer: bytes):
    """(offset, length, head fields, block) of each record of an unpacked frame."""
    at = 0
    while at < len(buffer):
        if not buffer.startswith(b"WARC/1.1\r\n", at):
            raise ValueError(f"no WARC record at byte {at} of a frame")
        end = buffer.index(b"\r\n\r\n", at)
        head = _fields(buffer[at:end])
        stop = end + 4 + int(head["Content-Length"])
        if buffer[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} of a frame has another length than it says")
        yield at, stop + 4 - at, head, buffer[end + 4 : stop]
        at = stop + 4


def read_page(head: dict[str, str], block: bytes) -> tuple:
    """A row of ``RECORD_SCHEMA``; a response whose payload does not have its digest or length is an error."""
    cut = block.index(b"\r\n\r\n") + 4
    n_bytes = int(_fields(block[: cut - 4])["Content-Length"])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    if head["WARC-Type"] == "response":
        payload = block[cut:]
        if len(payload) != n_bytes or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
    number = lambda k: int(head[k]) if k in head else None
    return (
        head["WARC-Record-ID"], number("Page-Id"), head.get("WARC-Target-URI"), head["WARC-Type"],
        number("Refers-To-Page-Id"), n_bytes, digest, payload,
    )


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The skippable frame behind the frames: (compressed size, size, checksum) of each, then the footer."""
    entries = b"".join(struct.pack("<III", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


class BundleWriter:
    """Writes one bundle frame by frame; it takes its final name when it is whole."""

    def __init__(self, folder: str, frame_bytes: int):
        import pyarrow.fs as pafs
        import zstandard

        self.files, base = pafs.FileSystem.from_uri(folder)
        self.files.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path = f"{base}/{self.name}"
        self.out = self.files.open_output_stream(f"{self.path}.open")
        self.coder = zstandard.ZstdCompressor(level=3)
        self.frame_bytes, self.parts, self.held, self.size = frame_bytes, [], 0, 0
        self.frames: list[tuple[int, int, int]] = []
        self.add(info_record(f"<urn:uuid:{uuid.uuid4()}>"))

    def add(self, record: bytes) -> tuple[int, int]:
        """Where the record lies: frame and offset within it."""
        where = len(self.frames), self.held
        self.parts.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self.close_frame()
        return where

    def close_frame(self) -> None:
        import xxhash

        if not self.parts:
            return
        raw = b"".join(self.parts)
        packed = self.coder.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.size += len(packed)
        self.parts, self.held = [], 0

    def close(self) -> None:
        self.close_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.files.move(f"{self.path}.open", self.path)


class BundleReader:
    """Goes to the frames of one bundle by its seek table."""

    def __init__(self, folder: str, name: str):
        import pyarrow.fs as pafs
        import zstandard

        files, base = pafs.FileSystem.from_uri(folder)
        self.file, self.decoder = files.open_input_file(f"{base}/{name}"), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError(f"{name} does not end in a seek table with checksums")
        entries = self.file.read_at(12 * n, size - 9 - 12 * n)
        self.frames, self.starts, at = list(struct.iter_unpack("<III", entries)), [], 0
        for packed, _, _ in self.frames:
            self.starts.append(at)
            at += packed

    def frame(self, i: int) -> bytes:
        import xxhash

        packed, size, check = self.frames[i]
        raw = self.decoder.decompress(self.file.read_at(packed, self.starts[i]), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return raw

    def close(self) -> None:
        self.file.close()


def _batches(rows, names, kinds, limit: int = 8 * 1024 * 1024):
    """Record batches of tuples, at most about ``limit`` payload bytes each."""
    import pyarrow as pa

    held, size = [], 0

    def batch():
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    for row in rows:
        held.append(row)
        size += 200 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if size >= limit or len(held) >= 10_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _kinds(schema: str):
    import pyarrow as pa

    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    pairs = [c.split() for c in schema.split(", ")]
    return [n for n, _ in pairs], [types[t] for _, t in pairs]


def _keyed(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"), html.alias("html"))
    return rows.withColumn("same", F.sha2("html", 256)).withColumn("n_bytes", F.octet_length("html").cast("bigint"))


def write_bundles(
    pages: DataFrame,
    path: str,
    min_revisit_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    hot_copies: int = HOT_COPIES,
) -> None:
    """Write a record for each row of ``pages`` to bundles under ``path``, and the index of the records.

    The payload is ``html`` in UTF-8 (null: empty) under ``url``, where there is
    one. Of rows with equal payloads of ``min_revisit_bytes`` or more the one with
    the largest ``page_id`` is a response and the others revisit it; a null page_id
    is less than all others. Rows that repeat a page_id and payload are records of
    their own, of which one is the response at most. Other columns are not read;
    an empty table gives an index without rows. Payloads are held one frame at a
    time, whatever their length.

    One pass counts payload digests. Then rows are dealt out by digest, those of a
    frequent payload (at most 1,000 of them, by their share) by page as well: their
    response is known from the count, so their revisits travel without payload.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = f"{path}/bundles"
    keyed = _keyed(pages)
    counts = keyed.filter(F.col("n_bytes") >= min_revisit_bytes).groupBy("same").agg(
        F.count("*").alias("n"), F.max("page_id").alias("first_page")
    )
    total = pages.count()
    # At most 1 / HOT_SHARE digests reach the share.
    hot = counts.filter(F.col("n") >= max(hot_copies, total * HOT_SHARE)).select(
        "same", "first_page", F.lit(True).alias("hot")
    )
    marked = keyed.join(F.broadcast(hot), "same", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    follows = F.col("hot") & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    rows = marked.select(
        "page_id", "url", F.when(~follows, F.col("html")).alias("html"), "same", "n_bytes", F.sha1("html").alias("sha1"),
        "hot", "first_page", F.when(F.col("hot"), F.xxhash64("same", "page_id")).otherwise(F.xxhash64("same")).alias("deal"),
    )
    ordered = rows.repartition("deal").sortWithinPartitions("same", F.desc_nulls_last("page_id"), "url")
    names, kinds = _kinds(INDEX_SCHEMA)

    def write(batches):
        import pyarrow as pa

        bundle, last, first, copy, waiting = None, None, None, 0, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                page, url, html, same, n_bytes, sha1, is_hot, hot_page = row
                if last is None or last[0] != same:
                    first = hot_page if is_hot else page
                    seen = False
                copy = copy + 1 if last == (same, page) else 0
                last = (same, page)
                digest = base32_digest(sha1)
                own = record_id(page, digest, copy)
                if n_bytes < min_revisit_bytes or (not seen and page == first):
                    refers, seen = None, True
                else:
                    refers = (record_id(first, digest, 0), first)
                record = made_record(own, page, url, digest, n_bytes, html, refers)
                if bundle is None:
                    bundle = BundleWriter(folder, frame_bytes)
                frame, offset = bundle.add(record)
                waiting.append((own, page, "revisit" if refers else "response", bundle.name, frame, offset, len(record)))
                if bundle.size >= bundle_bytes:
                    bundle.close()
                    bundle = None
                    yield from _batches(waiting, names, kinds)
                    waiting = []
        if bundle:
            bundle.close()
            yield from _batches(waiting, names, kinds)

    ordered.drop("deal").mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``record_id``, ``page_id``, ``record_type`` and where the record lies: ``bundle``, ``frame``, ``offset``, ``length``."""
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def read_bundles(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All pages of the bundles that the index names, a row of ``RECORD_SCHEMA`` each; one task reads a bundle at least.

    ``refers_to`` is the page a revisit stands for; the payload of a revisit is
    null. Damaged frames or payloads, and a bundle that holds another number of
    records than the index says, are errors.
    """
    ship(spark)
    folder = f"{path}/bundles"
    names, kinds = _kinds(RECORD_SCHEMA)

    def rows(batches):
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, n = BundleReader(folder, name), 0
                for i in range(len(reader.frames)):
                    for _, _, head, block in parsed_records(reader.frame(i)):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        n += 1
                        row = read_page(head, block)
                        yield row if payloads else (*row[:-1], None)
                reader.close()
                if n != expected:
                    raise ValueError(f"{name} holds {n} pages; the index has {expected}")

    bundles = read_index(spark, path).groupBy("bundle").agg(F.count("*").alias("n"))
    return bundles.mapInArrow(lambda batches: _batches(rows(batches), names, kinds), RECORD_SCHEMA)


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records whose id is in ``wanted.record_id``, by index and seek table: only their frames are unpacked."""
    ship(spark)
    folder = f"{path}/bundles"
    names, kinds = _kinds(RECORD_SCHEMA)

    def rows(batches):
        reader = opened = frame = raw = None
        for batch in batches:
            for name, i, offset, length in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if opened != name:
                    if reader:
                        reader.close()
                    reader, opened, frame = BundleReader(folder, name), name, None
                if frame != i:
                    raw, frame = reader.frame(i), i
                ((_, _, head, block),) = parsed_records(raw[offset : offset + length])
                yield read_page(head, block)
        if reader:
            reader.close()

    at = read_index(spark, path).join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    near = at.select("bundle", "frame", "offset", "length").repartition("bundle", "frame")
    return near.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(
        lambda batches: _batches(rows(batches), names, kinds), RECORD_SCHEMA
    )


def warc_rows(pages: DataFrame) -> DataFrame:
    """Write the bundles to the shared folder, read them back, and give each page's record."""
    spark = pages.sparkSession
    path = scratch(spark, "warc-bundles")
    write_bundles(pages, path)
    return read_bundles(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


WARC_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS place,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest
  FROM pages)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '')
         AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN newest END AS refers_to
FROM hashed
"""
