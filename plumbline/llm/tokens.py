"""Token ids of whole texts, by a public byte-level BPE vocabulary.

The ids are those of the ``tokenizers`` library. Texts in prose repeat their
words, and in a byte-level BPE a single space followed by other than white space
always begins a token of its own. So the texts of a batch are cut there, between a
Latin letter or digit and a mark such as a full stop behind it, and around a line
break before a Latin word, as no token spans these. Each distinct part is encoded once
by the library and kept in a pool of ids, and the ids of the texts are taken from
there, all in arrays. A text with white space beside a space is given to the library as a whole.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np

#: Parts kept per Python worker, and their characters; when full, those of the texts at hand and those seen often stay.
KEPT_PARTS = 300_000
KEPT_CHARS = 16_000_000

#: Begins a part that stands behind no space; a text that holds it is given to the library as a whole.
_MARK = "\x01"
_LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
_WHITE = r"[\pZ\x00-\x20\x7F-\xA0]"
_UNUSUAL = rf"{_WHITE}\x20|\x20{_WHITE}|\x20\z|{_MARK}"
#: A token never spans the two groups, nor the line break between them.
_LINES = rf"([{_LETTERS}0-9.,;:!?)])\n([{_LETTERS}])"
_TAILS = rf"([{_LETTERS}0-9])([.,;:!?)*#$%&])"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _runs(ids: np.ndarray, lengths: np.ndarray):
    """An Arrow array of binary values: runs of so many ``ids``, one behind the other."""
    import pyarrow as pa

    ends = np.concatenate([[0], 4 * np.cumsum(lengths)]).astype(np.int64)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), buffers)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, keeping the ids of frequent parts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose token begins with a space
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.line = np.zeros(len(self.spaced), bool)  # the id of a line break
        self.line[[i for token, i in vocabulary.items() if token == "Ċ"]] = True
        self._keep([], _runs(np.zeros(0), np.zeros(0)), np.zeros(0, np.int32))

    def _keep(self, parts: list[str], runs, seen: np.ndarray) -> None:
        """Let these parts be the pool: their ids, and in how many batches each was seen."""
        self.place = dict(zip(parts, range(len(parts)), strict=True))
        self.runs, self.seen = runs, seen
        self.chars = sum(map(len, parts))

    def _forget_rare(self, at_hand: np.ndarray) -> None:
        """Keep of the pool the places at hand and, as half of it at most, those seen in several batches."""
        parts = list(self.place)
        least = 2
        while np.count_nonzero(self.seen >= least) > KEPT_PARTS // 2:
            least += 1
        kept = self.seen >= least
        kept[at_hand] = True
        if sum(len(parts[k]) for k in np.flatnonzero(kept).tolist()) > KEPT_CHARS // 2:
            kept[:] = False
            kept[at_hand] = True
        places = np.flatnonzero(kept)
        self._keep([parts[k] for k in places.tolist()], self.runs.take(places), self.seen[places] // 2)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _one_by_one(self, parts: list[str]):
        own = [x for at in range(0, len(parts), 2000) for x in self._library(parts[at : at + 2000])]
        return _runs(np.concatenate([*own, np.zeros(0, "<u4")]), np.array([len(x) for x in own]))

    def _joined(self, parts: list[str], glue: str, opens: np.ndarray, keep: int):
        """The ids of parts behind ``glue``, of many in one call; the token that ``opens`` a part belongs to it if ``keep``."""
        import pyarrow as pa

        out = []
        for at in range(0, len(parts), 2000):
            some = parts[at : at + 2000]
            (ids,) = self._library([glue + glue.join(some)])
            cuts = np.flatnonzero(opens[ids])
            if len(cuts) == len(some):
                own = np.diff(cuts, append=len(ids)) - (not keep)
                out.append(_runs(ids if keep else np.delete(ids, cuts), own))
            else:
                out.append(self._one_by_one([glue + p if keep else p for p in some]))
        return pa.concat_arrays([_runs(np.zeros(0), np.zeros(0)), *out])

    def _learn(self, parts: list[str]) -> None:
        """Put the ids of new parts into the pool."""
        import pyarrow as pa

        spaced = [p for p in parts if p[0] != _MARK]
        words = [p for p in parts if p[0] == _MARK and p[1:].isalpha()]
        others = [p for p in parts if p[0] == _MARK and not p[1:].isalpha()]
        runs = [
            self._joined(spaced, " ", self.spaced, True),
            self._joined([p[1:] for p in words], "\n", self.line, False),
            self._one_by_one([p[1:] for p in others]),
        ]
        self.runs = pa.concat_arrays([self.runs, *runs])
        self.place.update(zip(spaced + words + others, range(len(self.place), len(self.runs)), strict=True))
        self.seen = np.concatenate([self.seen, np.zeros(len(parts), np.int32)])
        self.chars += sum(map(len, parts))

    def _places(self, parts: list[str]) -> np.ndarray:
        """The pool's places of distinct parts."""
        find = lambda some: np.fromiter(map(self.place.get, some, repeat(-1)), np.int64, len(some))
        found = find(parts)
        absent = np.flatnonzero(found < 0)
        if len(absent):
            new = [parts[k] for k in absent.tolist()]
            if len(self.place) + len(new) > KEPT_PARTS or self.chars > KEPT_CHARS:
                self._forget_rare(found[found >= 0])
                self._learn(new)
                found = find(parts)
            else:
                self._learn(new)
                found[absent] = find(new)
        self.seen[found] += 1
        return found

    def _by_parts(self, texts) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        mark, nothing = pa.scalar(_MARK, pa.large_string()), pa.scalar("", pa.large_string())
        texts = pc.replace_substring_regex(texts, _LINES, rf"\1 {_MARK}" + "\n" + rf" {_MARK}\2")
        texts = pc.replace_substring_regex(texts, _TAILS, rf"\1 {_MARK}\2")
        cut = pc.split_pattern(pc.binary_join_element_wise(mark, texts, nothing), " ")
        coded = cut.flatten().dictionary_encode()
        places = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = self.runs.take(pa.array(places[coded.indices.to_numpy()]))
        ends = np.frombuffer(flat.buffers()[1], np.int64)[np.asarray(cut.offsets)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(ends), flat.buffers()[2]]).to_pylist()

    def encode(self, texts) -> list[bytes]:
        """The ids of each text of a list or an Arrow array, without special tokens; a null text has none."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _UNUSUAL)
        n_whole = pc.sum(whole).as_py() or 0
        cut = self._by_parts(texts.filter(pc.invert(whole)) if n_whole else texts) if n_whole < len(texts) else []
        if not n_whole:
            return cut
        # One at a time: the library holds some hundred bytes a token.
        own = (self._library([t])[0].tobytes() for t in texts.filter(whole).to_pylist())
        cut = iter(cut)
        return [next(own if w else cut) for w in whole.to_pylist()]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded_batches(batches, path: str, budget: int = 6_000_000):
    """(record batch rows, ids) from Arrow batches with ``text``, at most about ``budget`` bytes at a time."""
    import pyarrow.compute as pc

    coder = encoder(path)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        begin = size = 0
        for end, own in enumerate(sizes, 1):
            size += own
            if size >= budget or end == len(sizes):
                rows = batch.slice(begin, end - begin)
                yield rows, coder.encode(rows.column("text"))
                begin, size = end, 0
