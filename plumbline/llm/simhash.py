"""SimHash near-duplicates through sharded BK-trees.

A text's fingerprint has a bit for each position set in over half of the XXH64
hashes of its 4-word shingles. Equal fingerprints collapse to one row first. Two
fingerprints that differ in at most ``RADIUS`` of 64 bits agree on at least two
of six blocks of bits, so each goes to the 15 shards named by a pair of its
blocks. A shard's fingerprints form a BK-tree (children keyed by their integer
Hamming distance to the parent) and a search follows only the edges within the
radius. A shard gives a spanning forest of its links; star contraction joins
those of all shards.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import roots
from plumbline.llm.shared import ship, written

SHINGLE = 4
SEED = 42
RADIUS = 4
#: First bit and width of the six blocks: four differing bits leave two of them whole.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PAIRS = tuple(combinations(range(len(BLOCKS)), 2))
#: Shards up to this size are searched node by node, larger ones with numpy.
SMALL_SHARD = 24
#: Fingerprints that one tree holds; the pieces of a larger shard are half as large and meet in pairs.
SHARD = 50_000
#: Open (query, node) places of a search at once, at most so many for the root's level.
OPEN_PLACES = 1 << 22

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """The shingles of ``size`` words, repeats included; all words if they are fewer, none if there are none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    begins = [0, *(e + 1 for e in ends[:-size])]
    return [joined[a:b] for a, b in zip(begins, ends[size - 1 :], strict=True)]


def votes(hashes):
    """For each of 64 positions the hashes that have the bit set."""
    import numpy as np

    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def majority(counts, n: int) -> int:
    """The fingerprint of ``n`` hashes by their votes: the bits set in over half of them."""
    import numpy as np

    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text; zero without words."""
    import numpy as np
    import xxhash

    digest, found = xxhash.xxh64_intdigest, shingles(text)
    if not found:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        counts += votes(np.array([digest(s, SEED) for s in found[at : at + (1 << 16)]], np.uint64))
    return majority(counts, len(found))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``fp``) of each row, the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def hashed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(fps)})

    rows = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text")
    return rows.mapInArrow(hashed, "doc_id bigint, fp bigint")


class Tree:
    """A BK-tree of 64-bit fingerprints: ``child[node, d]`` is the child at Hamming distance ``d``."""

    def __init__(self, fps):
        import numpy as np

        self.fps = fps
        values = fps.tolist()
        children: list[dict[int, int]] = [{} for _ in values]
        for i in range(1, len(values)):
            at = 0
            while True:
                d = (values[i] ^ values[at]).bit_count()
                below = children[at].get(d)
                if below is None:
                    children[at][d] = i
                    break
                at = below
        self.first = np.zeros(len(values) + 1, np.int64)  # a node's edges: a run of (distance, child)
        self.first[1:] = np.cumsum([len(c) for c in children])
        self.distance = np.array([d for c in children for d in c], np.int64)
        self.child = np.array([k for c in children for k in c.values()], np.int64)

    def search(self, queries, radius: int):
        """(query, node) numbers of all pairs within the radius."""
        import numpy as np

        at = np.arange(len(queries))
        nodes = np.zeros(len(queries), np.int64)
        found = []
        while len(at):
            d = np.bitwise_count(queries[at] ^ self.fps[nodes]).astype(np.int64)
            near = d <= radius
            found.append((at[near], nodes[near]))
            degree = self.first[nodes + 1] - self.first[nodes]
            ends = np.cumsum(degree)
            owner = np.repeat(np.arange(len(at)), degree)
            edge = np.arange(len(owner)) - np.repeat(ends - degree, degree) + self.first[nodes][owner]
            keep = np.abs(self.distance[edge] - d[owner]) <= radius
            at, nodes = at[owner[keep]], self.child[edge[keep]]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _small_links(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join the components of a few fingerprints, each searched for in the tree of those before it."""
    children: list[dict[int, int]] = [{} for _ in fps]
    group, out = list(range(len(fps))), []
    for i in range(1, len(fps)):
        open_, at = [0], 0
        while open_:
            at = open_.pop()
            d = (fps[i] ^ fps[at]).bit_count()
            if d <= radius and group[at] != group[i]:
                out.append((at, i))
                old, new = group[i], group[at]
                group = [new if g == old else g for g in group]
            open_ += [k for e, k in children[at].items() if abs(e - d) <= radius]
        at = 0
        while (below := children[at].get((fps[i] ^ fps[at]).bit_count())) is not None:
            at = below
        children[at][(fps[i] ^ fps[at]).bit_count()] = i
    return out


def _large_links(fps, radius: int) -> list[tuple[int, int]]:
    """Links from the first found of each component to the others: a flood over the tree, each node searched once."""
    import numpy as np

    tree, unseen, out = Tree(fps), np.ones(len(fps), bool), []
    step = max(1, min(512, OPEN_PLACES // len(fps)))
    for seed in range(len(fps)):
        if not unseen[seed]:
            continue
        unseen[seed] = False
        layer = np.array([seed])
        while len(layer):
            fresh = []
            for at in range(0, len(layer), step):
                if not unseen.any():
                    break
                _, hit = tree.search(fps[layer[at : at + step]], radius)
                hit = np.unique(hit[unseen[hit]])
                unseen[hit] = False
                fresh.append(hit)
            layer = np.concatenate([*fresh, np.zeros(0, np.int64)])
            out += [(seed, int(k)) for k in layer]
    return out


def _shard_links(batches, radius: int = RADIUS):
    """Links of the shards in sorted (pair, value, i, j) order; only one shard, or two pieces of one, is held at a time."""
    import numpy as np
    import pyarrow as pa

    def links(fps, reps):
        if len(fps) <= SMALL_SHARD:
            found = _small_links(fps.tolist(), radius)
        else:
            found = _large_links(fps, radius)
        return [(int(reps[a]), int(reps[b])) for a, b in found]

    held: tuple | None = None
    for batch in batches:
        *names, fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        fp = fp.view(np.uint64)
        out: list[tuple[int, int]] = []
        if not len(fp):
            continue
        cuts = np.flatnonzero(np.any([np.diff(name) != 0 for name in names], axis=0)) + 1
        bounds = [0, *cuts.tolist(), len(fp)]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(int(name[a]) for name in names)
            if held and held[0] == key:
                held = (key, [*held[1], fp[a:b]], [*held[2], rep[a:b]])
                continue
            if held and sum(map(len, held[1])) > 1:
                out += links(np.concatenate(held[1]), np.concatenate(held[2]))
            held = (key, [fp[a:b]], [rep[a:b]])
        yield pa.record_batch({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})
    if held and sum(map(len, held[1])) > 1:
        out = links(np.concatenate(held[1]), np.concatenate(held[2]))
        yield pa.record_batch({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def dealt_to_shards(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """(``pair``, ``value``, ``i``, ``j``, ``fp``, ``rep``): each ``fp`` in its shards, or in all pairs of pieces it belongs to.

    The large shards are met by a plain join: how many there are grows with the
    input, so Spark broadcasts them only where their size allows it.
    """
    cut = lambda i: F.shiftrightunsigned("fp", BLOCKS[i][0]).bitwiseAND((1 << BLOCKS[i][1]) - 1)
    keys = F.array(
        *[
            F.struct(F.lit(k).cast("long").alias("pair"), F.shiftleft(cut(i), 11).bitwiseOR(cut(j)).alias("value"))
            for k, (i, j) in enumerate(PAIRS)
        ]
    )
    sharded = distinct.select(F.explode(keys).alias("k"), "fp", "rep").select("k.pair", "k.value", "fp", "rep")
    large = sharded.groupBy("pair", "value").agg(F.count("*").alias("n")).filter(F.col("n") > shard)
    large = large.select("pair", "value", F.ceil(2 * F.col("n") / shard).cast("int").alias("pieces"))
    dealt = sharded.join(large, ["pair", "value"], "left").withColumn("own", F.expr("cast(pmod(xxhash64(fp), pieces) AS int)"))
    others = F.expr("filter(sequence(0, pieces - 1), k -> k <> own)")
    dealt = dealt.withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(0)))))
    return dealt.withColumn("own", F.coalesce("own", F.lit(0))).select(
        "pair", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "rep"
    )


def near_links(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """Links (``a``, ``b``) between the ``rep`` of distinct ``fp`` that join all within the radius."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt_to_shards(distinct, shard)
    ordered = dealt.repartition(n, "pair", "value", "i", "j").sortWithinPartitions("pair", "value", "i", "j")
    return ordered.mapInArrow(_shard_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` and ``component_id``, the least doc_id reachable by links.

    Null and empty texts have the fingerprint zero and link like others; repeated
    rows and ties share a fingerprint. A row with a null doc_id
    takes the component of its fingerprint, which is null and links to none where
    no row of that fingerprint has a doc_id. An empty table gives no rows; other columns are not
    read.
    """
    ship(docs.sparkSession)
    prints = written(fingerprints(docs), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    named = distinct.filter("rep IS NOT NULL")
    joined = roots(near_links(named))
    component = distinct.join(joined, distinct["rep"] == joined["node"], "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id")
    )
    return prints.join(component, "fp").select("doc_id", "fp", "component_id")


def component_rows(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the least of their component; null doc_ids stay.

    Rows of one doc_id are one document and stay or go together.
    """
    gone = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
