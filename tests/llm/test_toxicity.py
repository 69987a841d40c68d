import random
import zlib

import numpy as np
import pytest

from edges import empty_documents, odd_documents
from plumbline.llm import toxicity as T
from plumbline.llm.licenses import Words

BAD = ["fool", "scoundrel", "rotten"]


def made(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        if toxic:
            for _ in range(3):
                text.insert(rng.randint(0, len(text)), rng.choice(BAD))
        out.append((i, " ".join(text), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = made(600)
    return T.train([r[1] for r in rows], [r[2] for r in rows])


def test_held_out_accuracy(spark):
    rows = made(800)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(5, None, 0), (None, 1, 0)], "doc_id long, toxic int, quality int")
    found = {r["doc_id"]: r for r in T.toxicity_rows(docs.repartition(3), labels).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in found if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r["held_out"]} == set(held)
    assert np.mean([found[i]["predicted"] == truth[i] for i in held]) > 0.97
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in found.values())


def test_held_out_labels_teach_nothing(spark):
    rows = made(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = [(i, y) for i, _, y in rows]
    spoiled = [(i, 1 - y) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, y) for i, y in labels]
    a, b = (T.fitted(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, spoiled))
    assert all((a.weights[k] == b.weights[k]).all() for k in a.weights)


def test_gradients(model):
    rng = np.random.default_rng(0)
    small = T.Model(model.codes, {k: v.astype(np.float64) for k, v in model.weights.items()})
    gates = rng.normal(0, 1, (4, T.WINDOW, 2, 3 * T.HIDDEN))
    sizes, seed = np.array([T.WINDOW, 5, 1, 20]), rng.normal(0, 1, 4)
    _, kept = small.forward(gates, sizes, keep=True)
    grads, d_gates = small.backward(kept, seed)
    for name, at in (("rec", (0, 2, 7)), ("rec", (1, 3, 20)), ("look", (5,)), ("out", (9,))):
        old, eps, values = small.weights[name][at], 1e-3, []
        for sign in (1, -1):
            small.weights[name][at] = old + sign * eps
            values.append((small.forward(gates, sizes) * seed).sum())
        small.weights[name][at] = old
        assert abs((values[0] - values[1]) / (2 * eps) - grads[name][at]) < 1e-2 * (1 + abs(grads[name][at]))
    values = []
    for sign in (1, -1):
        moved = gates.copy()
        moved[1, 3, 0, 11] += sign * 1e-3
        values.append((small.forward(moved, sizes) * seed).sum())
    assert abs((values[0] - values[1]) / 2e-3 - d_gates[1, 3, 0, 11]) < 1e-2


def test_a_text_has_the_score_of_its_highest_window(model):
    text = " ".join(["w1 w2 w3"] * 200 + ["fool rotten"] + ["w4 w5"] * 100)
    words = text.split()
    windows = [" ".join(words[i : i + T.WINDOW]) for i in range(0, len(words), T.STRIDE)]
    alone = [T.score_texts(model, [w])[0] for w in windows[: -(-(len(words) - T.WINDOW) // T.STRIDE) + 1]]
    assert abs(T.score_texts(model, [text])[0] - max(alone)) < 1e-4 and max(alone) > 0.5


def test_windows_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 48, 49, 500])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    text, begin, size = T.windows_of(counts, first)
    for i, n in enumerate(counts):
        own = [(b - first[i], k) for t, b, k in zip(text, begin, size) if t == i]
        assert {x for b, k in own for x in range(b, b + k)} == set(range(n)) and own


def test_characters():
    words = Words(["ab abcdefghij " + "x" * 30])
    rows = T.characters(words, np.arange(3))
    assert bytes(rows[0][rows[0] > 0]) == b"ab" and bytes(rows[1][rows[1] > 0]) == b"abcdefghij" and (rows[2] > 0).sum() == 16


def test_edges(spark, model):
    docs = odd_documents(spark)
    assert T.score(docs, model).count() == docs.count()
    assert T.score(empty_documents(spark), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = T.toxicity_rows(docs, labels).collect()
    assert len(rows) == docs.count() and len({r["score"] for r in rows}) == 1
    one = spark.createDataFrame([(4, 1), (6, 1), (7, 1)], "doc_id long, toxic int")
    assert {r["predicted"] for r in T.toxicity_rows(docs, one).collect()} == {1}


def test_every_byte_of_a_long_word_is_read(model):
    """Three words of equal length, beginning and end, one of which spells an insult in its middle."""
    words = ["prefixed" + middle + "suffixed" for middle in ("scoundrel", "harmless1", "abcdefghi")]
    assert len({float(x) for x in T.score_texts(model, words)}) == 3
    parts = T.Parts(["日本語の長い文章には空白がありません" * 3, None, "short", "x" * 40])
    raw = [b"".join(parts.text(a, b)) for a, b in zip(parts.first, parts.first[1:])]
    assert raw == [("日本語の長い文章には空白がありません" * 3).encode(), b"", b"short", b"x" * 40]
    assert max(parts.end - parts.begin) <= T.PART
    for a, b in zip(parts.begin, parts.end):
        parts.buffer[a:b].decode()


def test_what_reaches_the_driver_is_bounded(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    short = T.excerpt(long, 3)
    assert len(short) < T.EXCERPT and set(short.split()) <= set(long.split()) and short == T.excerpt(long, 3)
    docs = spark.createDataFrame([(1, "a fool"), (1, "b fool"), (1, None), (2, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    T.fitted(docs.repartition(3), labels)
