"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its embedding (learned for words of the training sample) beside
the mean embedding of its characters, which every word has. Two gated recurrent
passes read a window of words, attention pools their states, and a text's score
is that of its highest window. Windows overlap by half and cover the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.licenses import Words
from plumbline.llm.shared import ship

#: The training sample: so many labelled documents of each class at most, and windows of each.
SAMPLE_PER_CLASS = 1500
SAMPLE_WINDOWS = 64
WINDOW, STRIDE = 32, 16
#: Bytes of a word, or of each part of a longer one.
PART = 16
#: Bytes of a sampled text that go to the driver as they are; of a longer one, sampled windows go.
EXCERPT = 64 * 1024
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
VOCABULARY = 20_000
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.01, 0.1
CHUNK = 4096
#: Texts that are scored together, in characters.
BUDGET = 3_000_000


class Parts(Words):
    """Words of a batch of texts; a longer one is cut, between characters, into parts of ``PART`` bytes at most."""

    def __init__(self, texts: list[str | None]):
        super().__init__(texts)
        size = self.end - self.begin
        if not (size > PART).any():
            return
        step = PART - 3  # a cut moves back to the beginning of its character
        n = np.where(size > PART, -(-size // step), 1)
        ends = np.cumsum(n)
        k = np.arange(ends[-1]) - np.repeat(ends - n, n)
        data = np.frombuffer(self.buffer, np.uint8)
        begin = np.repeat(self.begin, n) + k * step
        for _ in range(3):
            begin = begin - ((k > 0) & (data[begin] & 0xC0 == 0x80))
        self.end = np.where(k == np.repeat(n, n) - 1, np.repeat(self.end, n), np.append(begin[1:], 0))
        self.begin = begin
        self.first = np.concatenate([[0], ends])[self.first]
        self.counts = np.diff(self.first)
        self.code = self.hashed()


def characters(words: Words, at: np.ndarray) -> np.ndarray:
    """The bytes of each part of a word, 0 where it is shorter than ``PART``."""
    data = np.frombuffer(words.buffer, np.uint8)
    places = words.begin[at][:, None] + np.arange(PART)
    inside = places < words.end[at][:, None]
    return np.where(inside, data[np.minimum(places, len(data) - 1)], 0)


def excerpt(text: str | None, seed: int) -> str | None:
    """A text of at most ``EXCERPT`` bytes, or that much of its windows: ``SAMPLE_WINDOWS`` at random."""
    if text is None or len(text.encode("utf-8", "surrogatepass")) <= EXCERPT:
        return text
    parts = Parts([text])
    _, begin, size = windows_of(parts.counts, parts.first[:-1])
    chosen = np.sort(np.random.default_rng(seed).permutation(len(begin))[:SAMPLE_WINDOWS])
    out, done = [], 0
    for a, n in zip(begin[chosen].tolist(), size[chosen].tolist(), strict=True):
        out += parts.text(max(a, done), a + n)
        done = a + n
    return b" ".join(out).decode("utf-8", "replace")


def windows_of(counts: np.ndarray, first: np.ndarray):
    """(text, first word, words) of the overlapping windows of texts; a text without words has an empty one."""
    n = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), n)
    ends = np.cumsum(n)
    k = np.arange(len(text)) - np.repeat(ends - n, n)
    begin = first[text] + k * STRIDE
    return text, begin, np.clip(counts[text] - k * STRIDE, 0, WINDOW)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Model:
    codes: np.ndarray  # sorted hashes of the known words; row k + 1 of ``word`` is that of codes[k]
    weights: dict[str, np.ndarray]

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(codes), np.int64)
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[place] == codes, place + 1, 0)

    def inputs(self, numbers: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """What each word gives the gates of both directions, (words, 2, 3 * HIDDEN)."""
        w = self.weights
        size = np.maximum(1, (chars > 0).sum(axis=1, keepdims=True))
        mean = w["char"][chars].sum(axis=1) / size
        x = np.concatenate([w["word"][numbers], mean], axis=1)
        return (x @ w["in"] + w["bias"]).reshape(len(x), 2, 3 * HIDDEN)

    def forward(self, gates: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows from their words' gate inputs (windows, WINDOW, 2, 3 * HIDDEN)."""
        w, n, h = self.weights, len(gates), HIDDEN
        mask = np.arange(WINDOW)[None, :] < lengths[:, None]
        whole = bool(mask.all())
        states = np.zeros((2, WINDOW, n, h), np.float32)
        cache = []
        for d in (0, 1):
            state, u = np.zeros((n, h), np.float32), w["rec"][d]
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                g, q = gates[:, t, d], state @ u
                zr = _sigmoid(g[:, : 2 * h] + q[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(g[:, 2 * h :] + r * q[:, 2 * h :])
                after = new + z * (state - new)
                if not whole:
                    after = np.where(mask[:, t, None], after, state)
                if keep:
                    cache.append((d, t, state, z, r, new, q[:, 2 * h :]))
                state = states[d, t] = after
        both = np.concatenate([states[0], states[1]], axis=2)
        raw = both @ w["look"]
        raw = np.where(mask.T, raw, -1e9)
        share = np.exp(raw - raw.max(axis=0))
        share = np.where(mask.T, share, 0)
        share /= np.maximum(share.sum(axis=0), 1e-9)
        pooled = (share[:, :, None] * both).sum(axis=0)
        logits = pooled @ w["out"] + w["out_bias"][0]
        return (logits, (mask, both, share, pooled, cache)) if keep else logits

    def backward(self, kept, d_logits: np.ndarray):
        """Gradients of the weights behind the gates, and of the gate inputs."""
        mask, both, share, pooled, cache = kept
        w, h = self.weights, HIDDEN
        grads = {"out": pooled.T @ d_logits, "out_bias": np.array([d_logits.sum()], np.float32)}
        d_pool = d_logits[:, None] * w["out"]
        d_share = (both * d_pool).sum(axis=2)
        d_raw = share * (d_share - (share * d_share).sum(axis=0))
        grads["look"] = np.einsum("tn,tnk->k", d_raw, both)
        d_both = share[:, :, None] * d_pool + d_raw[:, :, None] * w["look"]
        grads["rec"] = np.zeros_like(w["rec"])
        d_gates = np.zeros((len(pooled), WINDOW, 2, 3 * h), np.float32)
        carry = [np.zeros((len(pooled), h), np.float32) for _ in (0, 1)]
        for d, t, state, z, r, new, qn in reversed(cache):
            total = carry[d] + d_both[t, :, d * h : (d + 1) * h]
            live = mask[:, t, None]
            own = np.where(live, total, 0)
            d_z, d_new = own * (state - new) * z * (1 - z), own * (1 - z) * (1 - new * new)
            d_r = d_new * qn * r * (1 - r)
            d_q = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_gates[:, t, d] = np.concatenate([d_z, d_r, d_new], axis=1)
            grads["rec"][d] += state.T @ d_q
            carry[d] = np.where(live, own * z + d_q @ w["rec"][d].T, total)
        return grads, d_gates


class _Adam:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}
        self.t = 0

    def step(self, weights, grads, rate: float) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            weights[k] -= rate * (m / (np.sqrt(v) + 1e-8) + DECAY * weights[k])


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """A model from labelled texts; without texts of both classes it scores everything alike."""
    rng = np.random.default_rng(seed)
    words, y = Parts(texts), np.array(labels, np.float32)
    owner = np.repeat(np.arange(len(texts)), words.counts)
    codes, some, place = np.unique(words.code, return_index=True, return_inverse=True)
    pairs = np.unique(place.astype(np.int64) * (len(texts) + 1) + owner)
    of, held = pairs // (len(texts) + 1), pairs % (len(texts) + 1)
    toxic = np.bincount(of, y[held], len(codes)) if len(of) else np.zeros(0)
    every = np.bincount(of, minlength=len(codes)) if len(of) else np.zeros(0)
    known = np.flatnonzero(every >= 2)
    known = np.sort(known[np.argsort(-every[known], kind="stable")[:VOCABULARY]])
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((every - toxic + 0.5) / (n0 + 1))
    odds = np.clip(odds * every / (every + 10), -4, 4)

    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    word = small(len(known) + 1, WORD_DIM)
    word[0] = 0
    word[1:, 0] = odds[known]
    weights = {
        "word": word,
        "char": small(256, CHAR_DIM),
        "in": rng.normal(0, 0.3, (WORD_DIM + CHAR_DIM, 6 * HIDDEN)).astype(np.float32),
        "bias": np.zeros(6 * HIDDEN, np.float32),
        "rec": rng.normal(0, 0.3, (2, HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "look": small(2 * HIDDEN),
        "out": rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }
    weights["char"][0] = 0
    model = Model(codes[known], weights)
    if not n1 or not n0 or not len(place):
        weights["out"][:] = 0
        weights["out_bias"][0] = 4.0 if n1 and not n0 else -4.0
        return model
    numbers, chars = model.numbers(codes), characters(words, some)  # of each distinct word
    signal = np.concatenate([[0], np.cumsum(word[numbers, 0][place])])
    text, begin, size = windows_of(words.counts, words.first[:-1])
    order = rng.permutation(len(text))
    order = order[np.argsort(text[order], kind="stable")]
    rank = np.arange(len(text)) - np.searchsorted(text[order], text[order])
    chosen = np.sort(order[rank < SAMPLE_WINDOWS])
    text, begin, size = text[chosen], begin[chosen], size[chosen]
    hint = signal[begin + size] - signal[begin]
    first = np.searchsorted(text, np.arange(len(texts) + 1))

    def gathered(own: np.ndarray):
        at = np.minimum(begin[own, None] + np.arange(WINDOW), len(place) - 1)
        flat = place[at.reshape(-1)]
        return flat, model.inputs(numbers[flat], chars[flat]).reshape(len(own), WINDOW, 2, 3 * HIDDEN)

    adam = _Adam(weights)
    for epoch in range(EPOCHS):
        for docs in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            if epoch == 0:
                best = np.array([first[i] + np.argmax(hint[first[i] : first[i + 1]]) for i in docs])
            else:
                own = np.concatenate([np.arange(first[i], first[i + 1]) for i in docs])
                logits = np.concatenate(
                    [model.forward(gathered(own[a : a + 1024])[1], size[own[a : a + 1024]]) for a in range(0, len(own), 1024)]
                )
                cuts = np.cumsum([0, *(first[i + 1] - first[i] for i in docs)])
                best = np.array([own[a + np.argmax(logits[a:b])] for a, b in zip(cuts, cuts[1:])])
            flat, gates = gathered(best)
            logits, kept = model.forward(gates, size[best], keep=True)
            d_logits = ((_sigmoid(logits) - y[docs]) / len(docs)).astype(np.float32)
            grads, d_gates = model.backward(kept, d_logits)
            d = d_gates.reshape(len(flat), 6 * HIDDEN)
            count = np.maximum(1, (chars[flat] > 0).sum(axis=1, keepdims=True))
            mean = weights["char"][chars[flat]].sum(axis=1) / count
            x = np.concatenate([weights["word"][numbers[flat]], mean], axis=1)
            grads["in"], grads["bias"] = x.T @ d, d.sum(axis=0)
            d_x = d @ weights["in"].T
            grads["word"] = np.zeros_like(weights["word"])
            np.add.at(grads["word"], numbers[flat], d_x[:, :WORD_DIM])
            grads["word"][0] = 0
            grads["char"] = np.zeros_like(weights["char"])
            np.add.at(grads["char"], chars[flat].reshape(-1), np.repeat(d_x[:, WORD_DIM:] / count, PART, axis=0))
            grads["char"][0] = 0
            adam.step(weights, grads, RATE * (0.5 if epoch >= EPOCHS // 2 else 1))
    return model


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    """The score of each whole text: the highest of all its overlapping windows."""
    words = Parts(texts)
    codes, some, place = np.unique(words.code, return_index=True, return_inverse=True)
    gates = model.inputs(model.numbers(codes), characters(words, some)) if len(codes) else np.zeros((1, 2, 3 * HIDDEN))
    gates = gates.astype(np.float32)
    place = place if len(place) else np.zeros(1, np.int64)
    text, begin, size = windows_of(words.counts, words.first[:-1])
    order = np.argsort(-size, kind="stable")
    logits = np.empty(len(text), np.float32)
    for a in range(0, len(order), CHUNK):
        own = order[a : a + CHUNK]
        at = np.minimum(begin[own, None] + np.arange(WINDOW), len(place) - 1)
        logits[own] = model.forward(gates[place[at]], size[own])
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, text, logits)
    return _sigmoid(best)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model of up to ``per_class`` labelled documents of each class, those with the least hash of doc_id.

    Only ids, then an excerpt of one text of each, reach the driver. Labels that are null
    or belong to no document or to the held-out fifth teach nothing; a doc_id
    with several labels has the highest, one with several texts the one of least hash.
    """
    ship(docs.sparkSession)
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = []
    for kind in (0, 1):
        rows = known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids += [(r["doc_id"], kind) for r in rows.collect()]
    if not ids:
        return train([], [])
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id bigint, toxic int")
    held = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            short = [excerpt(t, abs(i) if i is not None else 0) for i, t in zip(ids, texts, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(short, pa.string()), batch.column(2)], ["doc_id", "text", "toxic"])

    least = held.withColumn("h", F.xxhash64("text")).groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct("h", "text")).alias("text"))
    rows = least.select("doc_id", "text", "toxic").mapInArrow(cut, "doc_id bigint, text string, toxic int").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` and ``predicted``.

    A null or empty text is a window without words; repeated rows are scored one
    by one; a null doc_id is not held out; an empty table gives no rows; other
    columns are not read. No shuffle.
    """
    ship(docs.sparkSession)

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            begin = size = 0
            for end, t in enumerate(texts, 1):
                size += len(t or "")
                if size >= BUDGET or end == len(texts):
                    found = score_texts(model, texts[begin:end])
                    yield pa.record_batch({"doc_id": batch.column("doc_id").slice(begin, end - begin), "score": pa.array(found)})
                    begin, size = end, 0

    rows = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text").mapInArrow(scored, "doc_id bigint, score double")
    return rows.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def toxicity_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fitted(docs, labels))
