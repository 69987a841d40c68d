"""Ranked lexical search for many queries at once, with their common parts computed once.

A query's score of a document is a sum over its terms, so queries that share terms
share partial sums. For each group of queries a sharing plan is mined: terms that
stand in the same queries become one set, then the pair of parts that most queries
have in common becomes a part of its own, again and again. The plan is a DAG whose
nodes are partial document accumulators; for a batch of documents each node is
computed once from earlier ones and added to all queries above it.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.shared import scratch, ship, written

TOP = 50
#: Queries are worked off in blocks of so many terms (and queries) at most, which bounds what is broadcast.
BLOCK_TERMS = 200_000
BLOCK_ITEMS = 20_000
#: A block's queries are planned and evaluated in groups: rows of the accumulator matrix.
GROUP_TERMS = 4096
GROUP_ITEMS = 512
#: Parts of a query that are paired with each other; a longer query is paired piece by piece.
PAIRED_PARTS = 64
#: Documents whose accumulators are held together.
BATCH_DOCS = 512
#: Lots into which the tasks' best documents are merged first.
LOTS = 64

COUNT_SCHEMA = "doc_id bigint, n bigint, terms binary, tfs binary"
FOUND_SCHEMA = "item int, item_id bigint, doc_id bigint, score bigint"
RESULT_SCHEMA = "item_id bigint, rank int, doc_id bigint, score bigint"

#: Bytes of terms stay, A-Z as a-z; the rest becomes a space.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The maximal runs of digits, letters and bytes from 0x80, with A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split() if text else []


def sharing_plan(queries: list[list[int]], n_terms: int) -> tuple[list[list[int]], list[list[int]]]:
    """(nodes, roots): node i, numbered ``n_terms + i``, adds up its parts; a query adds up its roots.

    Parts are terms or earlier nodes, and every term of a query is below exactly one of its roots.
    """
    users: dict[int, list[int]] = defaultdict(list)
    for q, terms in enumerate(queries):
        for t in terms:
            users[t].append(q)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for t, qs in sorted(users.items()):
        alike[tuple(qs)].append(t)
    nodes: list[list[int]] = []
    roots: list[list[int]] = [[] for _ in queries]
    shared: list[list[int]] = [[] for _ in queries]

    def node(parts: list[int]) -> int:
        nodes.append(parts)
        return n_terms + len(nodes) - 1

    for qs, terms in alike.items():
        if len(qs) == 1:
            roots[qs[0]] += terms
            continue
        part = terms[0] if len(terms) == 1 else node(terms)
        for q in qs:
            shared[q].append(part)
    uses = {p: len(qs) for q in shared for p in q for qs in (users.get(p) or users[nodes[p - n_terms][0]],)}
    # Pieces of a query, most used parts first: only within a piece parts are paired.
    pieces: list[set[int]] = []
    piece_of: list[int] = []
    for q, parts in enumerate(shared):
        parts.sort(key=lambda p: (-uses[p], p))
        for at in range(0, len(parts), PAIRED_PARTS):
            pieces.append(set(parts[at : at + PAIRED_PARTS]))
            piece_of.append(q)
    holders: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, parts in enumerate(pieces):
        ordered = sorted(parts)
        for k, a in enumerate(ordered):
            for b in ordered[k + 1 :]:
                holders[a, b].add(i)
    heap = [(-len(own), pair) for pair, own in holders.items() if len(own) > 1]
    heapq.heapify(heap)
    while heap:
        count, pair = heapq.heappop(heap)
        own = holders.get(pair, ())
        if len(own) != -count:
            if len(own) > 1:
                heapq.heappush(heap, (-len(own), pair))
            continue
        new, grown = node(list(pair)), set()
        for i in list(own):
            pieces[i] -= set(pair)
            for old in pair:
                for other in pieces[i]:
                    holders[min(old, other), max(old, other)].discard(i)
            for other in pieces[i]:
                holders[other, new].add(i)
                grown.add((other, new))
            pieces[i].add(new)
        del holders[pair]
        for p in sorted(grown):
            if len(holders[p]) > 1:
                heapq.heappush(heap, (-len(holders[p]), p))
    for q, parts in zip(piece_of, pieces, strict=True):
        roots[q] += sorted(parts)
    return nodes, roots


def query_groups(queries: list[list[int]]) -> list[tuple]:
    """(first query, terms of the group in order, nodes, roots) of runs of queries with at most ``GROUP_TERMS`` terms."""
    groups, begin = [], 0
    while begin < len(queries):
        terms: dict[int, int] = {}
        end = begin
        while end < len(queries) and end - begin < GROUP_ITEMS:
            new = [t for t in queries[end] if t not in terms]
            if terms and len(terms) + len(new) > GROUP_TERMS:
                break
            terms.update(zip(new, range(len(terms), len(terms) + len(new)), strict=True))
            end += 1
        own = [[terms[t] for t in q] for q in queries[begin:end]]
        groups.append((begin, list(terms), *sharing_plan(own, len(terms))))
        begin = end
    return groups


class Best:
    """The ``top`` documents of one query so far: greatest score, then least doc_id, nulls first."""

    def __init__(self, top: int):
        import numpy as np

        self.top, self.least = top, 1
        self.scores, self.ids, self.known = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores, ids, known) -> None:
        import numpy as np

        at = np.flatnonzero(scores >= self.least)
        if not len(at):
            return
        scores = np.concatenate([self.scores, scores[at]])
        ids, known = np.concatenate([self.ids, ids[at]]), np.concatenate([self.known, known[at]])
        order = np.lexsort((ids, known, -scores))[: self.top]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]
        if len(order) == self.top:
            self.least = int(self.scores[-1])


def _item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` and the distinct terms of each query, sorted."""

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            own = [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(own, pa.list_(pa.binary()))], ["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(split, "item_id bigint, terms array<binary>")


def _blocks(items: DataFrame):
    """Lists of (item_id, terms), at most ``BLOCK_TERMS`` terms each unless one query has more."""
    block, size = [], 0
    for row in _item_terms(items).toLocalIterator():
        if block and (size + len(row["terms"]) > BLOCK_TERMS or len(block) == BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((row["item_id"], [bytes(t) for t in row["terms"]]))
        size += len(row["terms"])
    if block:
        yield block


def _counted(docs: DataFrame, vocabulary) -> DataFrame:
    """Each document's number of terms, and how often it holds those of ``vocabulary``; the texts are read once."""

    def count(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        number = vocabulary.value
        for batch in batches:
            ns, terms, tfs = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                found = Counter(filter(number.__contains__, words))
                ns.append(len(words))
                terms.append(np.fromiter(map(number.__getitem__, found), "<i4", len(found)).tobytes())
                tfs.append(np.fromiter(found.values(), "<i4", len(found)).tobytes())
            yield pa.record_batch(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())],
                ["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary"))
    return written(rows.mapInArrow(count, COUNT_SCHEMA), "term-counts")


def _document_frequencies(counted: DataFrame, n_terms: int) -> list[int]:
    """In how many documents each term of the vocabulary stands: a row per term and task is shuffled."""

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        out = np.zeros(n_terms, np.int64)
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            out += np.bincount(np.frombuffer(raw, "<i4"), minlength=n_terms)
        at = np.flatnonzero(out)
        yield pa.record_batch([pa.array(at.astype("i4")), pa.array(out[at])], ["term", "df"])

    df = [0] * n_terms
    rows = counted.select("terms").mapInArrow(sums, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    for row in rows.toLocalIterator():
        df[row["term"]] = row["df"]
    return df


def _scored(counted: DataFrame, plan, top: int) -> DataFrame:
    """The ``top`` documents of each query in each task."""

    def score(batches):
        import numpy as np
        import pyarrow as pa

        n_docs, n_words, weights, groups, names = plan.value
        best = [Best(top) for _ in names]
        place = []
        for _, terms, _, _ in groups:
            own = np.full(len(weights), -1, np.int32)
            own[terms] = np.arange(len(terms), dtype=np.int32)
            place.append(own)

        def add(ids, known, ns, terms, tfs):
            m = 100 - 50 + (50 * ns * n_docs) // n_words
            doc = np.repeat(np.arange(len(ns)), [len(t) // 4 for t in terms])
            term = np.frombuffer(b"".join(terms), "<i4")
            tf = np.frombuffer(b"".join(tfs), "<i4").astype(np.int64)
            part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            for (begin, own_terms, nodes, roots), own in zip(groups, place, strict=True):
                sums = np.zeros((len(own_terms) + len(nodes), len(ns)), np.int64)
                at = own[term]
                inside = at >= 0
                sums[at[inside], doc[inside]] = part[inside]
                for i, parts in enumerate(nodes, len(own_terms)):
                    np.sum(sums[parts], axis=0, out=sums[i])
                for q, parts in enumerate(roots, begin):
                    if parts:
                        best[q].add(sums[parts].sum(axis=0), ids, known)

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                some = batch.slice(at, BATCH_DOCS)
                ids = some.column(0)
                add(
                    ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False),
                    some.column(1).to_numpy(zero_copy_only=False), some.column(2).to_pylist(), some.column(3).to_pylist(),
                )
        for q, found in enumerate(best):
            n = len(found.scores)
            if n:
                yield pa.record_batch(
                    {
                        "item": pa.array([q] * n, pa.int32()),
                        "item_id": pa.array([names[q]] * n, pa.int64()),
                        "doc_id": pa.array(found.ids, mask=~found.known),
                        "score": pa.array(found.scores),
                    }
                )

    found = counted.filter("n > 0").mapInArrow(score, FOUND_SCHEMA)
    lots = found.withColumn("lot", F.spark_partition_id() % LOTS)
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    for keys in (["item", "lot"], ["item"]):
        lots = lots.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        lots = lots.filter(F.col("rank") <= top)
    return lots.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents with a score above 0 for each row of ``items``: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Terms are runs of letters, digits and characters from U+0080, A-Z lower-cased,
    in the whole text; a null or empty text has none. A term's weight is
    floor(1000 ln((2N+2)/(2df+1))) over all N documents that hold a term; a document
    adds w * (10^9 tf // (1000 tf + 20 m)), its m being 50 + 50 n N // L for n of L
    terms. Equal scores go by doc_id, nulls first. Every row of ``docs`` is a
    document and every row of ``items`` a query, also where ids repeat or are null;
    other columns are not read; without documents or queries there are no rows.

    The queries are worked off in blocks of bounded size. A block's terms go to all
    tasks, which count them in the whole texts once and write the counts; scoring
    reads the counts, keeps ``top`` documents a query and task, and merges these in
    two steps, so no task gets more than a share of the tasks' best.
    """
    spark = docs.sparkSession
    ship(spark)
    path = None
    for block in _blocks(items):
        number: dict[bytes, int] = {}
        for _, terms in block:
            for t in terms:
                number.setdefault(t, len(number))
        if not number:
            continue
        counted = _counted(docs, spark.sparkContext.broadcast(number))
        n_docs, n_words = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_words:
            continue
        weights = [
            math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in _document_frequencies(counted, len(number))
        ]
        import numpy as np

        groups = query_groups([[number[t] for t in terms] for _, terms in block])
        plan = (n_docs, n_words, np.array(weights, np.int64), groups, [k for k, _ in block])
        path = path or scratch(spark, "ranked")
        _scored(counted, spark.sparkContext.broadcast(plan), top).write.mode("append").parquet(path)
    if path is None:
        return spark.createDataFrame([], RESULT_SCHEMA)
    return spark.read.schema(RESULT_SCHEMA).parquet(path)


SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs),
parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_words))) AS part
  FROM counts JOIN weights USING (term) JOIN lengths USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
