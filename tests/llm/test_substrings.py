import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from edges import empty_documents, odd_documents
from plumbline.llm import substrings
from plumbline.llm.suffixes import suffix_array


def test_suffix_array_against_sorting():
    random.seed(3)
    for _ in range(4000):
        s = [random.randint(0, random.choice([1, 2, 3])) for _ in range(random.randint(0, 14))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for s in ([0] * 300, list(range(300)), list(range(300))[::-1], [1, 0] * 150, [random.randint(0, 9) for _ in range(700)]):
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows):
    """Per row the bytes, what goes, the spans and the digest, by every window."""
    least = {}
    for key, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            if key is not None:
                w = raw[i : i + 50]
                least[w] = min(least.get(w, key), key)
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if key is not None and least[raw[i : i + 50]] < key:
                gone[i : i + 50] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((key, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def compare(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert sorted((tuple(r) for r in substrings.substring_rows(docs).collect()), key=str) == brute(rows)


def made(seed, alphabet, n=40):
    rng = random.Random(seed)
    pieces = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 160))) for _ in range(12)]
    return [
        (rng.randint(0, 60), "".join(rng.choice(pieces)[rng.randint(0, 9) :] + rng.choice(["", "-", "é"]) for _ in range(rng.randint(0, 7))))
        for _ in range(n)
    ]


@pytest.mark.parametrize("alphabet", ["ab", "a\x00", "abcdefghij klmnop"])
def test_against_brute_force(spark, alphabet):
    compare(spark, made(1, alphabet))


def test_small_batches(spark):
    rows = made(2, "abcdefghij ")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = substrings.remove_repeated(docs, batch_bytes=600, bucket_bytes=100).drop("kept", "spans")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_ranges_and_shared_arrays(monkeypatch):
    """A bucket gives the same answers in one piece and in many."""
    parts = []
    for k, rows in enumerate((made(3, "abcdef "), made(4, "abcdef "), made(3, "abcdef "))):
        raw = [t.encode() for _, t in rows]
        row = {"doc_ids": [i for i, _ in rows], "sizes": [len(r) for r in raw], "data": b"".join(raw)}
        anchors = substrings._anchors_of(row)
        records, low, _ = substrings._distinct_contexts(row, anchors, np.arange(len(anchors.at)))
        parts.append((k, 0, substrings._packed(records), substrings._packed(low)))
    pdf = pd.DataFrame(parts, columns=["batch", "bucket", "records", "docs"])
    whole = substrings._answers(pdf)
    monkeypatch.setattr(substrings, "RANGE", 7)
    monkeypatch.setattr(substrings, "CONTEXTS", 3)
    pieces = substrings._answers(pdf)
    assert substrings._unpacked(whole["where"][0], np.int32).size > 0
    for name in ("low", "where", "windows"):
        assert whole[name].tolist() == pieces[name].tolist()


def test_lengths_at_the_limit(spark):
    s = "".join(random.Random(5).choice("abcdefgh") for _ in range(300))
    rows = [(1, s), (2, "#" + s[10:60] + "#"), (3, "#" + s[10:59] + "#"), (4, s[:50]), (5, s[:49]), (6, s[100:150] + s[160:210])]
    compare(spark, rows)


def test_edges(spark):
    docs = odd_documents(spark)
    found = sorted((tuple(r) for r in substrings.substring_rows(docs).collect()), key=str)
    assert found == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert substrings.substring_rows(empty_documents(spark)).count() == 0
    whole = substrings.remove_repeated(docs).filter("doc_id = 5").first()
    assert whole["kept"] == b"" and whole["spans"] == [0, whole["n_bytes"]]
