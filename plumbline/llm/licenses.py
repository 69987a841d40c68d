"""Licence scans through a positional index of rare licence words.

The templates' words are counted over all texts first, so each has its inverse
document frequency in this corpus. A template is indexed by its rarest words and
their positions. A text's occurrences of the rarest of these are looked up, the
postings are intersected by relative position (text position less template
position), and an alignment that gathers enough of a template's weight makes it a
candidate, which counts once one of its mandatory phrases stands in the text.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm.notices import TEMPLATES
from plumbline.llm.shared import ship

#: Phrases whose every place counts, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: A template is indexed by so many of its rarest words.
RARE_WORDS = 12
#: The share of the indexed weight that one alignment must gather.
SIMILARITY = 0.6
#: Positions that an insertion, such as a name, may move words apart.
DRIFT = 8

_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_WORD[128:] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


class Words:
    """The words of a batch of texts: their places in one buffer, their hashes, and the text each is in."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
        self.buffer = b" " * 8 + b" ".join(raw) + b" " * 9
        data = np.frombuffer(self.buffer, np.uint8)
        word = _WORD[data]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        self.begin, self.end = edge[::2], edge[1::2]
        at = np.cumsum([8, *(len(r) + 1 for r in raw)])
        self.first = np.searchsorted(self.begin, at)  # the first word of each text, and the end
        self.counts = np.diff(self.first)
        self.code = self.hashed()

    def hashed(self) -> np.ndarray:
        size = self.end - self.begin
        eight = np.ndarray((len(self.buffer) - 7,), "<u8", self.buffer, strides=(1,))
        head = eight[self.begin] & _MASKS[np.minimum(size, 8)]
        tail = np.where(size > 8, eight[np.maximum(self.end - 8, 0)], np.uint64(0))
        return (head * _P1) ^ (tail * _P2) ^ (size.astype(np.uint64) * _P3)

    def text(self, a: int, b: int) -> list[bytes]:
        return [self.buffer[i:j] for i, j in zip(self.begin[a:b], self.end[a:b], strict=True)]


@cache
def vocabulary() -> tuple[tuple[str, ...], np.ndarray, np.ndarray]:
    """All words of templates and phrases, their sorted hashes, and the word of each."""
    phrases = [*BASE, *(t.text for t in TEMPLATES), *(m for t in TEMPLATES for m in t.mandatory)]
    words = tuple(sorted({w for p in phrases for w in p.split()}))
    codes = Words([" ".join(words)]).code
    order = np.argsort(codes)
    return words, codes[order], order


def known(words: Words) -> np.ndarray:
    """The number of each word in the vocabulary, -1 for others, by hash and length; phrases compare the bytes."""
    names, codes, order = vocabulary()
    sieve = np.zeros(1 << 16, bool)
    sieve[(codes >> np.uint64(48)).astype(np.int64)] = True
    out = np.full(len(words.code), -1, np.int32)
    maybe = np.flatnonzero(sieve[(words.code >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(codes, words.code[maybe]), len(codes) - 1)
    hit = codes[place] == words.code[maybe]
    out[maybe[hit]] = order[place[hit]]
    lengths = np.array([len(n) for n in names])
    found = np.flatnonzero(out >= 0)
    out[found[lengths[out[found]] != (words.end - words.begin)[found]]] = -1
    return out


def places(words: Words, ids: np.ndarray, phrase: str) -> np.ndarray:
    """The words at which a phrase begins; it lies within one text."""
    names, parts = vocabulary()[0], phrase.split()
    number = {w: i for i, w in enumerate(names)}
    n = len(ids) - len(parts) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at = np.flatnonzero(ids[:n] == number[parts[0]])
    for k, w in enumerate(parts[1:], 1):
        at = at[ids[at + k] == number[w]]
    owner = np.searchsorted(words.first, at, "right")
    at = at[np.searchsorted(words.first, at + len(parts) - 1, "right") == owner]
    wanted = [w.encode() for w in parts]
    return np.array([i for i in at.tolist() if words.text(i, i + len(parts)) == wanted], np.int64)


def idf_of(counts: dict[str, int], n_docs: int) -> dict[str, float]:
    return {w: math.log((1 + n_docs) / (1 + counts.get(w, 0))) + 1 for w in vocabulary()[0]}


class Index:
    """Postings (word, position) of the rarest words of each template, and of its anchors among these.

    A template's anchors are its rarest words that together weigh more than 1 - SIMILARITY:
    an alignment without any of them cannot gather enough.
    """

    def __init__(self, idf: dict[str, float]):
        number = {w: i for i, w in enumerate(vocabulary()[0])}
        self.postings, anchors = [], []
        for t, template in enumerate(TEMPLATES):
            words = template.text.split()
            rare = sorted(set(words), key=lambda w: (-idf[w], w))[:RARE_WORDS]
            total = sum(idf[w] for w in rare)
            sums = np.cumsum([idf[w] / total for w in rare])
            first = set(rare[: int(np.searchsorted(sums, 1 - SIMILARITY + 1e-9)) + 1])
            places = [(number[w], p) for p, w in enumerate(words) if w in rare]
            weight = np.array([idf[words[p]] / total / words.count(words[p]) for _, p in places])
            self.postings.append((*np.array(places, np.int64).T, weight))
            anchors += [(number[w], t, p) for p, w in enumerate(words) if w in first]
        self.word, self.template, self.position = np.array(sorted(anchors), np.int64).T
        self.first = np.searchsorted(self.word, np.arange(len(number) + 1))

    def candidates(self, words: Words, ids: np.ndarray):
        """(texts, templates, shares): each template's best alignment in each text that holds one of its anchors.

        An alignment is a window of DRIFT shifts (place in the text less place in the template).
        Anchors give the windows, and the other postings are looked up there.
        """
        degree = np.append(np.diff(self.first), 0)[ids]
        at = np.flatnonzero(degree)
        degree = degree[at]
        owner = np.repeat(np.arange(len(at)), degree)
        ends = np.cumsum(degree)
        posting = np.arange(len(owner)) - np.repeat(ends - degree, degree) + self.first[ids[at]][owner]
        text = np.searchsorted(words.first, at[owner], "right") - 1
        template, shift = self.template[posting], at[owner] - words.first[text] - self.position[posting]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for move in (0, DRIFT // 2):
            begin = (shift + move) // DRIFT * DRIFT - move
            for t in np.unique(template):
                mine = template == t
                for rows in _slices(np.unique(np.stack([text[mine], begin[mine]], 1), axis=0)):
                    found.append((rows[:, 0], np.full(len(rows), t), self.shares(words, ids, t, *rows.T)))
        text, template, share = (np.concatenate(parts) for parts in zip(*found, strict=True))
        order = np.lexsort((-share, template, text))
        text, template, share = text[order], template[order], share[order]
        best = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(template) != 0)])[: len(text)]
        return text[best], template[best], share[best]

    def shares(self, words: Words, ids: np.ndarray, t: int, text: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The weight of a template's postings that stand at a shift of ``begin`` to ``begin + DRIFT - 1``."""
        word, position, weight = self.postings[t]
        low, high = words.first[text], words.first[text + 1]
        there = np.zeros((len(text), len(word)), bool)
        for k in range(DRIFT):
            place = (low + begin + k)[:, None] + position
            inside = (place >= low[:, None]) & (place < high[:, None])
            there |= inside & (ids[np.clip(place, 0, len(ids) - 1)] == word)
        return np.minimum(1.0, there @ weight)


def _slices(rows: np.ndarray, size: int = 8192):
    return (rows[a : a + size] for a in range(0, len(rows), size))


def _count(batches):
    """How many texts hold each vocabulary word; number -1 counts all texts."""
    import pyarrow as pa

    for batch in batches:
        words = Words(batch.column("text").to_pylist())
        ids = known(words)
        at = np.flatnonzero(ids >= 0)
        owner = np.searchsorted(words.first, at, "right")
        pairs = np.unique(owner * np.int64(1 << 20) + ids[at]) % (1 << 20)
        counts = np.bincount(pairs, minlength=1)
        some = np.flatnonzero(counts)
        yield pa.record_batch(
            {"word": pa.array([-1, *some.tolist()], pa.int64()), "n": pa.array([batch.num_rows, *counts[some].tolist()], pa.int64())}
        )


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double"
)


def corpus_idf(docs: DataFrame) -> dict[str, float]:
    """The weight of every template word, from its number of texts in all of ``docs``; a few hundred words reach the driver."""
    ship(docs.sparkSession)
    found = docs.select("text").mapInArrow(_count, "word bigint, n bigint").groupBy("word").sum("n").collect()
    by = {r[0]: r[1] for r in found}
    names = vocabulary()[0]
    return idf_of({names[i]: n for i, n in by.items() if i >= 0}, by.get(-1, 0))


def scan(docs: DataFrame, idf: dict[str, float] | None = None) -> DataFrame:
    """One row per row of ``docs``: counts and places of base phrases, ``base_labels``, ``labels`` and ``score``.

    ``score`` is 1 with a base phrase, else the best share of a template that gives
    its label, but at least half the best share of any alignment with an anchor. Of an SPDX expression the first
    name counts. A text of any length is scanned whole. Null and
    empty texts have no words, null places, empty labels and a score of 0;
    repeated rows are scanned one by one; an empty table gives no rows; other
    columns are not read. Two passes over the texts without a shuffle of them.
    """
    weights = corpus_idf(docs) if idf is None else idf

    def scanned(batches):
        import pyarrow as pa

        index = Index(weights)
        for batch in batches:
            words = Words(batch.column("text").to_pylist())
            ids, n = known(words), batch.num_rows
            n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base = [set() for _ in range(n)]
            score = np.zeros(n)
            for phrase, label in BASE.items():
                at = places(words, ids, phrase)
                text = np.searchsorted(words.first, at, "right") - 1
                place = at - words.first[text]
                np.add.at(n_base, text, 1)
                np.minimum.at(first, text, place)
                np.maximum.at(last, text, place)
                for i in text.tolist():
                    base[i].add(label)
            labels = [set(b) for b in base]
            score[n_base > 0] = 1.0
            text, template, share = index.candidates(words, ids)
            np.maximum.at(score, text, share / 2)
            strong = share >= SIMILARITY
            aligned = list(zip(text[strong].tolist(), template[strong].tolist(), share[strong].tolist(), strict=True))
            phrases = {
                m: set((np.searchsorted(words.first, places(words, ids, m), "right") - 1).tolist())
                for m in {m for _, t, _ in aligned for m in TEMPLATES[t].mandatory}
            }
            for i, t, part in aligned:
                if any(i in phrases[m] for m in TEMPLATES[t].mandatory):
                    labels[i].add(TEMPLATES[t].label)
                    score[i] = max(score[i], part)
            none = n_base == 0
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array(words.counts.astype(np.int64)),
                    "n_base": pa.array(n_base),
                    "first_word": pa.array(np.where(none, 0, first), pa.int64(), mask=none),
                    "last_word": pa.array(last, pa.int64(), mask=none),
                    "base_labels": pa.array([",".join(sorted(b)) for b in base]),
                    "labels": pa.array([",".join(sorted(b)) for b in labels]),
                    "score": pa.array(np.round(score, 6)),
                }
            )

    return docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text").mapInArrow(scanned, SCHEMA)
