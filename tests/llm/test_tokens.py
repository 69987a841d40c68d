import random
import zlib

import numpy as np
import pytest

from edges import empty_documents, odd_documents
from plumbline.llm import packing, rans, token_store
from plumbline.llm.tokens import Encoder, default_vocabulary

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def coder():
    return Encoder(default_vocabulary())


def plain(coder, text):
    return coder.library.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_library_ids(coder):
    random.seed(1)
    parts = ["a", "Be", ".", ",", " ", "  ", "\n", "é", "'s", "17", "\t", "日", "<|endoftext|>", "!", "\xa0", "word"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(4000)]
    texts += [None, "x" * 3000, "one. two,\nThree. four\nfive.. six"]
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain(coder, text), repr(text)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 65536, 65537, 150_000])
def test_coder_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_256).astype(np.uint32)
    assert (rans.decode_segment(rans.encode_segment(ids)) == ids).all()


def test_coder_blocks_and_checksums():
    ids = np.random.default_rng(5).integers(0, 5_000_000, 200_000).astype(np.uint32)
    data = rans.encode_segment(ids)
    assert (rans.decode_segment(data, [2]) == ids[2 * rans.BLOCK : 3 * rans.BLOCK]).all()
    spoiled = bytearray(data)
    spoiled[-40_000] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.decode_segment(bytes(spoiled))
    skew = np.where(np.random.default_rng(6).random(200_000) < 0.9, 7, ids % 50_000).astype(np.uint32)
    p = np.unique(skew, return_counts=True)[1] / len(skew)
    assert len(rans.encode_segment(skew)) * 8 < 1.35 * len(skew) * -(p * np.log2(p)).sum() + 8 * 200_000


def test_token_files(spark, tmp_path, coder):
    docs = odd_documents(spark)
    token_store.write_ids(docs, str(tmp_path / "ids"), segment_ids=3000)
    rows = token_store.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert keys == sorted(keys) and len(rows) == docs.count()
    at, texts = 0, {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(plain(coder, r["text"]) + [0])
    for r in rows:
        own = np.frombuffer(r["ids"], "<u4").tolist()
        assert own in texts[r["doc_id"]] and r["start"] == at and r["n_tokens"] == len(own)
        at += len(own)
    digest = token_store.token_rows(docs).orderBy("start").collect()
    assert [d["ids_crc32"] for d in digest if d["doc_id"] == 4] == [zlib.crc32(r["ids"]) for r in rows if r["doc_id"] == 4]
    assert token_store.token_rows(empty_documents(spark)).count() == 0


def brute_best_fit(lengths, window):
    open_, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [w for w in open_ if window - sum(w) >= lengths[i]]
        if fits:
            best = min(fits, key=lambda w: window - sum(w))
        else:
            open_.append(best := [])
        best.append(lengths[i])
        out[i] = best
    return sorted(tuple(w) for w in open_)


def test_best_fit_against_brute_force():
    random.seed(2)
    for _ in range(60):
        lengths = [random.randint(1, 63) for _ in range(random.randint(0, 60))]
        placed = packing.best_fit(lengths, 64)
        rows = {}
        for i, (s, o) in enumerate(placed):
            rows.setdefault(s, []).append((o, lengths[i]))
        for own in rows.values():
            at = 0
            for o, k in sorted(own):
                assert o == at
                at += k
            assert at <= 64
        loads = sorted(sum(k for _, k in own) for own in rows.values())
        assert loads == sorted(map(sum, brute_best_fit(lengths, 64)))


def test_packing(spark, coder):
    docs = odd_documents(spark)
    rows = packing.pack(docs.filter("doc_id <> 3")).collect()
    whole, sequences = {}, {}
    for r in rows:
        whole.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for r in docs.filter("doc_id <> 3").collect():
        ids = b"".join(x for _, x in sorted(whole[r["doc_id"]]))
        assert np.frombuffer(ids, "<u4").tolist() == plain(coder, r["text"]) + [0]
    for own in sequences.values():
        at = 0
        for o, k in sorted(own):
            assert o == at
            at += k
        assert at <= packing.WINDOW
    assert sum(r["length"] for r in packing.packed_rows(docs).filter("doc_id = 3").collect()) == 2 * 4
    assert packing.packed_rows(empty_documents(spark)).count() == 0


def test_a_full_pool_keeps_the_parts_at_hand(monkeypatch):
    from plumbline.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_PARTS", 120)
    coder = tokens.Encoder(tokens.default_vocabulary())
    first = ["first " + " ".join(f"old{i}" for i in range(100))]
    second = ["then " + " ".join([*(f"old{i}." for i in range(0, 100, 2)), *(f"new{i}," for i in range(60))])]
    learned, learn = [], coder._learn
    monkeypatch.setattr(coder, "_learn", lambda parts: learned.append(set(parts)) or learn(parts))
    for texts in (first, second, first):
        want = [np.array(coder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert coder.encode(texts) == want
    assert len(learned) == 3 and not learned[0] & learned[1]


def test_cuts_at_marks_and_line_breaks_give_the_library_ids(coder):
    random.seed(4)
    parts = ["Wort", "é", "x9", ".", ";", "!", "'ll", "#*", ")", "\n", "\n", " ", " ", " ", "\x01", "\x85", " ", "<|endoftext|>", "日本", "7"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 20))) for _ in range(6000)]
    texts += [" ", "\n", "\x01", " one", "one ", "\none two", "a\n\nb c", "a\n b", "one.\nTwo three,\nFour 3.14 a.b.c"]
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain(coder, text), repr(text)


def test_parts_seen_often_outlast_a_full_pool(monkeypatch):
    from plumbline.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_PARTS", 300)
    coder = tokens.Encoder(tokens.default_vocabulary())
    often = "start " + " ".join("oft" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(100))
    learned, learn = [], coder._learn
    monkeypatch.setattr(coder, "_learn", lambda parts: learned.extend(parts) or learn(parts))
    for texts in ([often], [often], *(["start " + " ".join(f"rare{n}x{i}" for i in range(150))] for n in range(2)), [often]):
        want = [np.array(coder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert coder.encode(texts) == want
    assert len(learned) == len(set(learned)) == 101 + 300 and len(coder.place) < 300


def test_few_texts_reach_the_library(coder, monkeypatch):
    """Words behind a line break are encoded together; texts given as a whole come alone, as the library holds much a token."""
    calls, library = [], coder._library
    monkeypatch.setattr(coder, "_library", lambda texts: calls.append(list(texts)) or library(texts))
    letters = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(600)]
    text = "Alone " + " ".join(f"{a}zq{b}.\nNeu{a}{b}vx" for a, b in zip(letters, reversed(letters), strict=True))
    texts = [text, *("two  spaces " * 50 for _ in range(5))]
    for ids, text in zip(coder.encode(texts), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain(coder, text)
    assert sum(map(len, calls)) < 20
    assert max(sum(map(len, c)) for c in calls if any("  " in t for t in c)) <= 600
