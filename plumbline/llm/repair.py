"""Repair of a conversation's structure by the cheapest edits.

The rows of a conversation are kept, given another role, deleted, or joined by
inserted empty messages, so that the initials of the roles are an optional system
message and then pairs of user and assistant, or nothing. A path through the DAG
(row, place in that pattern) is one integer: its high digits are the cost, and
each edit letter is a digit of fixed width at its position behind them, zeros
standing behind the last letter. So the least integer is the cheapest path and,
of those, the one whose letters come first in ASCII order; ``min`` decides it all.

The integers of a long conversation would grow with it. After each block of rows
they are rebased: letters that have been decided leave the integers, and of what
differs between the paths only the order stays, as one leading digit. Every path
also carries the SHA-256 of the messages it has made, so texts are read once and
none is held.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.shared import ship

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Digits in ASCII order; zero ends an audit.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
BITS = 3
#: Rows between two rebases.
BLOCK_ROWS = 256
#: Characters by which rows that must be deleted are ordered within a turn and role.
ORDER_CHARS = 64

#: Places in the pattern: nothing yet, after the system message, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a message with the initial may follow, by initial.
FOLLOWS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

SCHEMA = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)
SPACE = "\x20\x09-\x0d"


class Paths:
    """The best path to each place of the pattern, as integers, while rows arrive one by one."""

    def __init__(self, block_rows: int = BLOCK_ROWS):
        # A leading digit for the order, at most two inserts before the block's rows, and three letters a row.
        self.width = BITS * (1 + 2 + 3 * block_rows)
        self.block_rows, self.rows = block_rows, 0
        self.value = {START: 0}
        self.length = {START: 1}
        self.hash = {START: hashlib.sha256()}
        self.empty = {START: True}
        #: Letters that have left the integers: (letters, what was before them), shared between paths.
        self.done: dict[int, tuple | None] = {START: None}
        self._insert()

    def _step(self, place: int, cost: int, letter: str) -> int:
        """The integer of ``place``'s path with one more edit."""
        at = self.width - BITS * (self.length[place] + 1)
        return self.value[place] + (cost << self.width) + (DIGIT[letter] << at)

    def _move(self, found: dict[int, list[tuple[int, int, bytes | None]]]) -> None:
        """Each place takes the least of what reaches it: (integer, place it comes from, message)."""
        best = {to: min(ways, key=lambda w: w[0]) for to, ways in found.items()}
        old = (self.value, self.length, self.hash, self.empty, self.done)
        self.value, self.length, self.hash, self.empty, self.done = ({} for _ in old)
        for to, (value, came, message) in best.items():
            self.value[to] = value
            self.length[to] = old[1][came] + (value != old[0][came])
            self.done[to] = old[4][came]
            self.empty[to], self.hash[to] = old[3][came], old[2][came]
            if message is not None:
                own = old[2][came].copy()
                own.update(message if old[3][came] else b"\n" + message)
                self.hash[to], self.empty[to] = own, False

    def _insert(self) -> None:
        for initial in "ua":
            found = {p: [(v, p, None)] for p, v in self.value.items()}
            for came, to in FOLLOWS[initial].items():
                if came in self.value:
                    found.setdefault(to, []).append((self._step(came, INSERT, "I"), came, f"{NAMES[initial]}:".encode()))
            self._move(found)

    def row(self, role: str, text: bytes | None, must_go: bool, truncated: bool) -> None:
        if self.rows == self.block_rows:
            self._rebase()
        self.rows += 1
        found: dict[int, list] = {p: [(self._step(p, DELETE, "D"), p, None)] for p in self.value}
        if not must_go:
            more = TRUNCATED if truncated else 0
            for came in self.value:
                to = FOLLOWS.get(role[:1], {}).get(came)
                if to is not None:
                    value = self._step(came, KEEP + more, "K")
                    found.setdefault(to, []).append((value, came, role.encode() + b":" + text))
                for initial, name in NAMES.items():
                    to = FOLLOWS[initial].get(came)
                    if to is not None:
                        value = self._step(came, REROLE + more, "R")
                        found.setdefault(to, []).append((value, came, name.encode() + b":" + text))
        self._move(found)
        self._insert()

    def _letters(self, place: int) -> str:
        n, low = self.length[place], self.value[place] & ((1 << self.width) - 1)
        digits = (low >> (self.width - BITS * (i + 1)) & 7 for i in range(1, n))
        names = {d: c for c, d in DIGIT.items()}
        return "".join(names[d] for d in digits)

    def _rebase(self) -> None:
        """Take the letters out of the integers and leave the paths' order as their leading digit.

        Inserts behind the last row stay: up to there all paths have a letter for
        each row, so none begins another one, and their order is settled.
        """
        before, stems, tails = self.done, {}, {}
        for p in self.value:
            letters = self._letters(p)
            stems[p] = letters.rstrip("I")
            tails[p] = len(letters) - len(stems[p])
        settled = {p: (self.value[p] >> (at := self.width - BITS * (1 + len(stems[p])))) << at for p in stems}
        mask = (1 << self.width) - 1
        ranks = {low: i for i, low in enumerate(sorted({v & mask for v in settled.values()}))}
        taken: dict[tuple, tuple] = {}
        self.done = {p: taken.setdefault((stem, id(before[p])), (stem, before[p])) for p, stem in stems.items()}
        for p, tail in tails.items():
            cost = self.value[p] >> self.width << self.width
            self.value[p] = cost + (ranks[settled[p] & mask] << (self.width - BITS))
            self.length[p] = 1
            for _ in range(tail):
                self.value[p] = self._step(p, 0, "I")
                self.length[p] += 1
        self.rows = 0

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and SHA-256 of the cheapest path that ends a whole conversation."""
        place = min((p for p in (START, ASSISTANT) if p in self.value), key=self.value.__getitem__)
        parts, node = [self._letters(place)], self.done[place]
        while node:
            parts.append(node[0])
            node = node[1]
        return self.value[place] >> self.width, "".join(reversed(parts)), self.hash[place].hexdigest()


class Conversation:
    """Counts of one conversation and its paths, from rows in order."""

    def __init__(self, conv_id: int | None, block_rows: int):
        self.conv_id, self.paths = conv_id, Paths(block_rows)
        self.turns, self.first, self.last = 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None

    def row(self, turn, role: str, text: bytes | None, n: int, fault: str) -> None:
        """``n`` equal rows, of which the first has the fault; the others are blank as well, or duplicates."""
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        if initial + initial not in LEGAL:
            self.illegal += n - 1
        self.initial = initial
        copies = n - 1
        if fault == "blank":
            self.blank += n
        else:
            self.duplicate += copies + (fault == "duplicate")
            self.truncated += fault == "truncated"
        self.paths.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        for _ in range(copies):
            self.paths.row(role, None, True, False)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        counts = (self.blank, self.duplicate, self.truncated, self.illegal)
        return (self.conv_id, gaps, *counts, *self.paths.result())


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with the damage that CRC-32 of ``conv_id:turn`` picks: the test bed of the repair.

    ``there`` is false for a dropped row and ``n`` is 2 for a repeated one. Nulls in
    ``role`` and ``text`` become one space, as they do in the key.
    """
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")))
    clean = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(key) % 20).alias("kind"),
    )
    kind, text = F.col("kind"), F.col("text")
    return clean.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("there"),
        F.when(kind == 3, 2).otherwise(1).cast("bigint").alias("n"),
    )


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per ``conv_id``: its faults, the cost and letters of the cheapest repair, and the result's SHA-256.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text``; optionally ``n``, how
    often a row stands there, and ``there``, false for a row that only names its
    conversation. Rows go by turn, nulls first, equal turns by role and text (of rows
    that must be deleted, its first ``ORDER_CHARS`` characters). A
    row's first fault counts: blank (no other than white space), duplicate (role
    and text seen earlier in the conversation), truncated (last character other than
    white space is none of ``.!?``). Null roles and texts are one space; a null
    conv_id is a conversation; an empty role fits nowhere and can be replaced or deleted; other
    columns are not read; an empty table gives no rows.

    Equal rows are counted before they are shuffled, duplicates lose their texts
    before the rows of a conversation meet, and the task that walks a conversation
    holds four paths, of a byte a row each, besides the row at hand: the hash asks
    for the whole conversation in order.
    """
    ship(rows.sparkSession)
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    known = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.when(there, F.col("turn").cast("bigint")).alias("turn"),
        F.when(there, F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(there, text).alias("text"),
        F.when(there, n).otherwise(0).cast("bigint").alias("n"),
    )
    counted = known.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    last = F.regexp_extract(F.col("text"), f"([^{SPACE}])[{SPACE}]*\\z", 1)
    fault = (
        F.when(last == "", "blank")
        .when(F.row_number().over(earlier) > 1, "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    # Of a row that must go only its place counts: the beginning of its text is enough to order it.
    faulty = counted.withColumn("fault", fault)
    shown = F.when(F.col("fault").isin("blank", "duplicate"), F.left("text", F.lit(ORDER_CHARS))).otherwise(F.col("text"))
    walked = faulty.select("conv_id", "turn", "role", shown.alias("text"), "n", "fault").repartition("conv_id")
    ordered = walked.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    ordered = ordered.withColumn("text", F.col("text").cast("binary"))

    def walk(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        at, out, size = None, [], 0

        def made():
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for conv_id, turn, role, text, n, fault in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if at is None or at.conv_id != conv_id:
                    if at is not None:
                        out.append(at.result())
                        size += len(out[-1][7])
                    if len(out) >= 10_000 or size > 4_000_000:
                        yield made()
                        out, size = [], 0
                    at = Conversation(conv_id, block_rows)
                if n:
                    at.row(turn, role, text, n, fault)
        if at is not None:
            out.append(at.result())
        if out:
            yield made()

    return ordered.mapInArrow(walk, SCHEMA)


def repair_rows(conversations: DataFrame) -> DataFrame:
    """The repair of the damaged conversations, every original ``conv_id`` included."""
    return repair(damaged(conversations))
