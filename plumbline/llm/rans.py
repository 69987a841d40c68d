"""A static range asymmetric numeral system over token ids, in numpy.

A segment is a run of ids with one frequency table, shared by its blocks. A block
holds up to ``LANES * STEPS`` ids, has its own coder states and word stream, and
decodes without the others: id ``t`` belongs to lane ``t % LANES``, so one step
codes a row of lanes at once. A block's entry in the segment's index is its
checkpoint: where its ids and words begin, its lanes' states, and the CRC-32 of
its ids, which the decoder verifies.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 64
STEPS = 1024
BLOCK = LANES * STEPS
MAGIC = b"PLRS"
#: States lie in [2**31, 2**63); words of 32 bits leave and enter at the bottom.
FLOOR = np.uint64(1 << 31)
_WORD = np.uint64(32)


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that sum to ``2**bits``, none of a present symbol zero."""
    total = 1 << bits
    freq = np.maximum(1, np.floor(counts * (total / counts.sum())).astype(np.int64))
    over = int(freq.sum()) - total
    if over < 0:
        freq[int(np.argmax(freq))] -= over
    while over > 0:
        order = np.argsort(-freq, kind="stable")
        room = freq[order] - 1
        take = np.minimum(room, np.maximum(1, room * over // max(1, int(room.sum()))))
        take = np.where(np.cumsum(take) <= over, take, np.maximum(0, over - (np.cumsum(take) - take)))
        freq[order] -= take
        over -= int(take.sum())
    return freq


def _encode_rows(sym: np.ndarray, freq: np.ndarray, start: np.ndarray, bits: int):
    """(states, words, words per block) of symbols shaped (blocks, steps, lanes)."""
    blocks, steps, lanes = sym.shape
    state = np.full((blocks, lanes), FLOOR, np.uint64)
    low = np.zeros((steps, blocks, lanes), np.uint32)
    sent = np.zeros((steps, blocks, lanes), bool)
    shift, up = np.uint64(bits), np.uint64(63 - bits)
    for t in range(steps - 1, -1, -1):
        s = sym[:, t]
        f = freq[s]
        out = state >= (f << up)
        sent[t] = out
        low[t] = state.astype(np.uint32)
        state = np.where(out, state >> _WORD, state)
        q = state // f
        state = (q << shift) + (state - q * f) + start[s]
    chosen = sent.transpose(1, 0, 2)
    return state, low.transpose(1, 0, 2)[chosen], chosen.reshape(blocks, -1).sum(axis=1)


def _decode_rows(state, words, at, steps, table, freq, start, bits):
    """Symbols (blocks, steps, lanes) from states and each block's place in ``words``."""
    blocks, lanes = state.shape
    out = np.empty((blocks, steps, lanes), np.int32)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    words = np.concatenate([words.astype(np.uint64), np.zeros(1, np.uint64)])
    at = at.astype(np.int64)[:, None]
    last = len(words) - 1
    for t in range(steps):
        slot = state & mask
        s = table[slot.astype(np.int64)]
        out[:, t] = s
        state = freq[s] * (state >> shift) + slot - start[s]
        need = state < FLOOR
        rank = np.cumsum(need, axis=1)
        place = np.minimum(at + rank - 1, last)
        state = np.where(need, (state << _WORD) | words[np.maximum(place, 0)], state)
        at = at + rank[:, -1:]
    return out


def _table_of(ids: np.ndarray):
    if int(ids.max()) < 1 << 22:
        every = np.bincount(ids)
        symbols = np.flatnonzero(every)
        counts, place = every[symbols], np.zeros(len(every), np.int64)
        place[symbols] = np.arange(len(symbols))
        places = place[ids]
    else:
        symbols, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
    bits = max(12, min(24, int(np.ceil(np.log2(len(symbols) + 1))) + 4))
    return symbols, places.astype(np.int64), scaled(counts, bits), bits


def _blocks_of(n: int):
    """(first id, ids, steps) of each block."""
    return [(a, min(BLOCK, n - a), -(-min(BLOCK, n - a) // LANES)) for a in range(0, n, BLOCK)]


def encode_segment(ids: np.ndarray) -> bytes:
    """One segment: header, compressed table, index of blocks, words."""
    n = len(ids)
    if n == 0:
        return MAGIC + struct.pack("<QBIII", 0, 0, 0, 0, 0)
    symbols, places, freq, bits = _table_of(ids)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    f64, blocks = freq.astype(np.uint64), _blocks_of(n)
    filler = int(np.argmax(freq))
    states, words, sizes = [], [], []
    full = n // BLOCK
    for sym in (
        places[: full * BLOCK].reshape(full, STEPS, LANES) if full else None,
        np.pad(places[full * BLOCK :], (0, -(n - full * BLOCK) % LANES), constant_values=filler).reshape(1, -1, LANES)
        if n % BLOCK
        else None,
    ):
        if sym is not None:
            a, b, c = _encode_rows(sym, f64, start, bits)
            states.append(a)
            words.append(b)
            sizes.append(c)
    sizes = np.concatenate(sizes).astype("<u4")
    crcs = np.array([zlib.crc32(ids[a : a + k].astype("<u4").tobytes()) for a, k, _ in blocks], "<u4")
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    head = MAGIC + struct.pack("<QBIII", n, bits, len(symbols), len(blocks), len(table))
    return b"".join(
        [head, table, sizes.tobytes(), crcs.tobytes(), np.concatenate(states).astype("<u8").tobytes(),
         np.concatenate(words).astype("<u4").tobytes()]
    )


def decode_segment(data: bytes, only: list[int] | None = None) -> np.ndarray:
    """The ids of a segment, or those of the blocks ``only``; raises ValueError where a checksum fails."""
    size = struct.calcsize("<QBIII")
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, bits, k, b, z = struct.unpack_from("<QBIII", data, 4)
    if n == 0:
        return np.empty(0, np.uint32)
    at = 4 + size
    table = np.frombuffer(zlib.decompress(data[at : at + z]), "<u4")
    symbols, freq = np.cumsum(table[:k]).astype(np.uint32), table[k:].astype(np.uint64)
    at += z
    sizes, crcs = np.frombuffer(data, "<u4", b, at), np.frombuffer(data, "<u4", b, at + 4 * b)
    states = np.frombuffer(data, "<u8", b * LANES, at + 8 * b).reshape(b, LANES)
    words = np.frombuffer(data, "<u4", offset=at + 8 * b + 8 * b * LANES)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    slots = np.repeat(np.arange(k, dtype=np.int32), freq.astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    blocks = _blocks_of(n)
    wanted = list(range(b)) if only is None else list(only)
    out: dict[int, np.ndarray] = {}
    for steps in sorted({blocks[i][2] for i in wanted}):
        own = [i for i in wanted if blocks[i][2] == steps]
        rows = _decode_rows(states[own].astype(np.uint64), words, begins[own], steps, slots, freq, start, bits)
        for i, row in zip(own, rows, strict=True):
            ids = symbols[row.reshape(-1)[: blocks[i][1]]]
            if zlib.crc32(ids.astype("<u4").tobytes()) != crcs[i]:
                raise ValueError(f"block {i} does not match its checksum")
            out[i] = ids
    return np.concatenate([out[i] for i in wanted]) if wanted else np.empty(0, np.uint32)
