import base64
import glob
import hashlib
import os

import pytest
import zstandard

from plumbline.llm import warc
from plumbline.llm.shared import scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, digest string, same long, hot string"
PAGES = [
    (1, "http://a/é x", "<p>one</p>"), (2, None, "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, "http://c\r\nX: y", ""), (4, "", None),
    (None, "http://d", "<p>one</p>"), (None, None, "alone"), (5, "http://e", "x" * 300_000), (5, "http://e", "y\r\n\r\nWARC/1.1\r\n"),
    (6, "http://f", "日本語"), (6, "http://f", "日本語"), (-7, "http://g", "<p>one</p>"),
]


def made(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "d", 1, "h") for r in rows], SCHEMA).repartition(3)


def brute(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of each row."""
    out, groups = [], {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    for raw, pages in groups.items():
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        pages.sort(key=lambda p: (p is None, -(p or 0)))
        for i, page in enumerate(pages):
            response = i == 0 or len(raw) < least
            out.append((page, len(raw), digest, "response" if response else "revisit", None if response else pages[0]))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [1000, 2])
@pytest.mark.parametrize("least", [0, 4])
def test_records_and_frequent_payloads(spark, hot, least):
    path = scratch(spark, "warc-test")
    warc.write_bundles(made(spark), path, least, hot_copies=hot)
    assert rows(warc.read_bundles(spark, path)) == brute(PAGES, least)


def test_round_trip_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    path = scratch(spark, "warc-test")
    warc.write_bundles(pages, path, frame_bytes=10_000, bundle_bytes=8_000)
    back = warc.read_bundles(spark, path)
    want = {(r["page_id"], r["url"], r["html"]) for r in pages.collect()}
    found = {(r["page_id"], r["url"], r["payload"].decode()) for r in back.filter("record_type = 'response'").collect()}
    assert found == want
    index = warc.read_index(spark, path)
    assert index.select("bundle").distinct().count() > 2 and index.agg({"frame": "max"}).first()[0] > 1


def test_any_tool_can_unpack_a_bundle(spark):
    path = scratch(spark, "warc-test")
    warc.write_bundles(made(spark), path, frame_bytes=100)
    entries = {r["record_id"]: r for r in warc.read_index(spark, path).collect()}
    assert len(entries) == len(PAGES)
    for file in glob.glob(f"{path.removeprefix('file://')}/bundles/*.zst"):
        with open(file, "rb") as f:
            raw = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        reader = warc.BundleReader(f"{path}/bundles", os.path.basename(file))
        assert b"".join(reader.frame(i) for i in range(len(reader.frames))) == raw
        for _, _, head, _ in warc.parsed_records(raw):
            if head["WARC-Type"] != "warcinfo":
                entry = entries.pop(head["WARC-Record-ID"])
                part = reader.frame(entry["frame"])[entry["offset"] :][: entry["length"]]
                assert f"WARC-Record-ID: {entry['record_id']}\r\n".encode() in part and part.endswith(b"\r\n\r\n")
    assert not entries


def test_fetch_by_record_id(spark):
    path = scratch(spark, "warc-test")
    warc.write_bundles(made(spark), path, frame_bytes=1000)
    index = warc.read_index(spark, path).filter("page_id in (3, 5, 6)")
    wanted = index.select("record_id").union(index.select("record_id")).unionByName(spark.createDataFrame([("<none>",)], "record_id string"))
    assert rows(warc.fetch(spark, path, wanted)) == [r for r in brute(PAGES) if r[0] in (3, 5, 6)]


def test_left_over_and_damaged_bundles(spark):
    path = scratch(spark, "warc-test")
    warc.write_bundles(made(spark), path)
    files = glob.glob(f"{path.removeprefix('file://')}/bundles/*.zst")
    with open(f"{os.path.dirname(files[0])}/left-over.warc.zst", "wb") as f:
        f.write(b"of a lost task")
    assert rows(warc.read_bundles(spark, path)) == brute(PAGES)
    with open(files[0], "r+b") as f:
        f.seek(30)
        f.write(b"\x00\x01\x02")
    with pytest.raises(Exception, match="damaged|rror"):
        warc.read_bundles(spark, path).collect()


def test_large_group_and_empty_table(spark):
    many = [(i, f"http://x/{i}", "the same page") for i in range(3000)] + [(i, None, f"page {i}") for i in range(3000, 3050)]
    assert rows(warc.warc_rows(made(spark, many))) == brute(many)
    assert warc.warc_rows(made(spark).limit(0)).count() == 0
    assert rows(warc.warc_rows(made(spark).select("page_id", "html"))) == brute(PAGES)
