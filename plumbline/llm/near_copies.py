"""Near copies by SimHash and by the Jaccard similarity of their five-word shingles.

Candidates are, first, sets whose SimHash fingerprints differ in at most four of 64
bits, found in the sharded BK-trees of ``simhash``; that misses most pairs below
0.95. So sets are candidates also if they share one of 64 keys, each made of five
of 320 MinHash values: two texts with a similarity of 0.8 share none with a
probability of 9e-12, nearer ones with less. The rows of a key are linked to its least text only, in each
batch before the shuffle and then over all, so a large group gives as many links
as rows. The components of these links hold all near copies together; inside
each the similarity is counted over the whole shingle sets, and only links of
0.8 or more make the final components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import roots, with_least
from plumbline.llm.shared import ship, written
from plumbline.llm.simhash import SEED, majority, near_links, shingles, votes

SHINGLE = 5
BANDS, ROWS = 64, 5
#: Shingles of a component that one task compares at once; a larger one is cut and its pieces meet in pairs.
PIECE = 2_000_000


def hashes(text: str | None):
    """The distinct hashes of a text's shingles, sorted."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in set(shingles(text, SHINGLE))], np.uint64))


def alike(overlap, a, b):
    """Whether sets of ``a`` and ``b`` shingles that share ``overlap`` have a similarity of 0.8 or more."""
    return 9 * overlap >= 4 * (a + b)


def key_maker():
    """The function from a set of shingle hashes to its keys, as signed longs."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
    plus = rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)

    def of(found):
        low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
        short = (found >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 2048):
            np.minimum(low, (odd[:, None] * short[at : at + 2048] + plus[:, None]).min(axis=1), out=low)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for column in low.reshape(BANDS, ROWS).T:
            keys = (keys ^ column) * np.uint64(0xBF58476D1CE4E5B9)
            keys ^= keys >> np.uint64(29)
        return keys.view(np.int64)

    return of


def sketches(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``fp``, ``n``, ``sim``, ``keys``) of each row: equal shingle sets have equal ``fp``.

    ``sim`` is the set's SimHash. It and ``keys`` are null without shingles or doc_id, and where
    the task has given those of the same set.
    """
    ship(docs.sparkSession)

    def sketched(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        seen, of = set(), key_maker()
        for batch in batches:
            ids, fps, sizes, sims, keys = batch.column("doc_id"), [], [], [], []
            for doc_id, text in zip(ids.to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = hashes(text)
                fp = xxhash.xxh64_intdigest(found.tobytes(), SEED)
                new = doc_id is not None and len(found) > 0 and fp not in seen
                if new:
                    seen.add(fp)
                fps.append(fp)
                sizes.append(len(found))
                sims.append(_signed(majority(votes(found), len(found))) if new else None)
                keys.append(of(found) if new else None)
            yield pa.record_batch(
                {
                    "doc_id": ids,
                    "fp": pa.array(np.array(fps, np.uint64).view(np.int64)),
                    "n": pa.array(sizes, pa.int64()),
                    "sim": pa.array(sims, pa.int64()),
                    "keys": pa.array(keys, pa.list_(pa.int64())),
                }
            )

    rows = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text")
    return rows.mapInArrow(sketched, "doc_id bigint, fp bigint, n bigint, sim bigint, keys array<bigint>")


def sim_links(sets: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that join all sets ``fp`` whose SimHash ``sim`` differ in at most ``simhash.RADIUS`` bits."""
    same = with_least(sets.selectExpr("sim AS a", "fp AS b"), sets.count())
    distinct = written(sets.groupBy(F.col("sim").alias("fp")).agg(F.min(sets["fp"]).alias("rep")), "distinct-fingerprints")
    return same.filter("b <> m").selectExpr("b AS a", "m AS b").unionByName(near_links(distinct))


def _batch_links(batches):
    """(``key``, ``fp``, ``to``): of the rows of a key in a batch the least goes on, the others are links to it.

    So a key that very many sets share leaves a batch as one row. Links carry their own ``fp`` as key, which spreads them.
    """
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        key = batch.column("keys").flatten().to_numpy(zero_copy_only=False)
        fp = np.repeat(batch.column("fp").to_numpy(zero_copy_only=False), BANDS)
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        leads = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        to = fp[leads][np.cumsum(leads) - 1]
        other = fp != to
        links = np.unique(np.stack([fp[other], to[other]], axis=1), axis=0)
        yield pa.record_batch(
            {
                "key": pa.array(np.concatenate([key[leads], links[:, 0]]), pa.int64()),
                "fp": pa.array(np.concatenate([fp[leads], links[:, 0]]), pa.int64()),
                "to": pa.array([None] * int(leads.sum()) + links[:, 1].tolist(), pa.int64()),
            }
        )


def _key_links(batches):
    """Links of the rows of a key, which come one after another, to its first, and the links of the batches."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    last_key, last_fp = None, 0
    for batch in batches:
        linked = batch.filter(pc.is_valid(batch.column("to")))
        links = np.stack([linked.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)], axis=1)
        batch = batch.filter(pc.is_null(batch.column("to")))
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if len(key):
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            first = fp[begins].copy()
            if last_key is not None and last_key == int(key[0]):
                first[0] = last_fp
            to = np.repeat(first, np.diff([*begins.tolist(), len(key)]))
            last_key, last_fp = int(key[-1]), int(to[-1])
            links = np.concatenate([links, np.stack([fp, to], axis=1)[fp != to]])
        links = np.unique(links, axis=0)
        yield pa.record_batch({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})


def set_links(sets: list) -> list[tuple[int, int]]:
    """Links that join all sets reachable over similarities of 0.8 or more, each set searched once."""
    import numpy as np

    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if alike(both, len(sets[0]), len(sets[1])) else []
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    words, code = np.unique(np.concatenate(sets), return_inverse=True)
    postings = owner[np.argsort(code, kind="stable")]
    count = np.bincount(code, minlength=len(words))
    begin = np.concatenate([[0], np.cumsum(count)])
    mark, unseen, out = np.zeros(len(words), bool), np.ones(len(sets), bool), []
    live_code, live_owner = code, owner  # those of unseen sets, and of some seen since
    for seed in range(len(sets)):
        if not unseen[seed]:
            continue
        unseen[seed] = False
        stack = [seed]
        while stack:
            at = stack.pop()
            own = code[starts[at] : starts[at + 1]]
            if count[own].sum() <= len(live_code):
                ends = np.cumsum(count[own])
                place = np.arange(ends[-1]) - np.repeat(ends - count[own], count[own]) + np.repeat(begin[own], count[own])
                overlap = np.bincount(postings[place], minlength=len(sets))
            else:
                mark[own] = True
                overlap = np.bincount(live_owner[mark[live_code]], minlength=len(sets))
                mark[own] = False
            hit = np.flatnonzero(unseen & alike(overlap, sizes[at], sizes))
            if len(hit):
                unseen[hit] = False
                stack += hit.tolist()
                out += [(at, int(k)) for k in hit]
                keep = unseen[live_owner]
                live_code, live_owner = live_code[keep], live_owner[keep]
            if not unseen.any():
                return out
    return out


def _verified(batches):
    """Verified links of the groups in sorted (root, i, j) order; only one group is held at a time."""
    import pyarrow as pa

    def links(group):
        found = set_links([s for _, s in group.values()]) if len(group) > 1 else []
        reps = [r for r, _ in group.values()]
        return [(reps[a], reps[b]) for a, b in found]

    key, group = None, {}
    for batch in batches:
        root, i, j, fp, rep = (batch.column(k).to_pylist() for k in range(5))
        out: list[tuple[int, int]] = []
        for at, text in enumerate(batch.column(5).to_pylist()):
            if (now := (root[at], i[at], j[at])) != key:
                out += links(group)
                key, group = now, {}
            if fp[at] not in group and _print(found := hashes(text)) == fp[at]:
                group[fp[at]] = rep[at], found
        yield pa.record_batch({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})
    out = links(group)
    yield pa.record_batch({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def _print(found) -> int:
    import xxhash

    return _signed(xxhash.xxh64_intdigest(found.tobytes(), SEED))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``component_id``, the least doc_id reachable over near copies.

    Texts without words are copies of one another. Null doc_ids and repeated rows
    are treated as in ``simhash.near_duplicates``.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(sketches(docs), "sketches")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "distinct-sets")
    keyed = rows.filter("keys IS NOT NULL").select("fp", "keys")
    keyed = keyed.mapInArrow(_batch_links, "key bigint, fp bigint, to bigint")
    sorted_ = keyed.repartition(n, "key").sortWithinPartitions("key", "fp")
    by_keys = sorted_.mapInArrow(_key_links, "a bigint, b bigint")
    found = roots(sim_links(rows.filter("sim IS NOT NULL").select("fp", "sim")).unionByName(by_keys))
    members = found.selectExpr("node AS fp", "root").unionByName(found.selectExpr("root AS fp", "root").distinct())
    members = members.join(distinct, "fp")
    pieces = members.groupBy("root").agg(F.ceil(F.sum("n") / PIECE).cast("int").alias("pieces"))
    members = members.join(pieces, "root").withColumn("own", F.expr("cast(pmod(xxhash64(fp), pieces) AS int)"))
    texts = docs.selectExpr("cast(doc_id as bigint) AS rep", "text").join(members, "rep")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")),
    )
    groups = texts.select("root", F.explode(pairs).alias("p"), "fp", "rep", "text")
    groups = groups.select("root", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "fp", "rep", "text")
    groups = groups.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    joined = roots(groups.mapInArrow(_verified, "a bigint, b bigint"))
    component = distinct.join(joined, distinct["rep"] == joined["node"], "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id")
    )
    return rows.select("doc_id", "fp").join(component, "fp").select("doc_id", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the least of their component; null doc_ids stay.

    Rows of one doc_id are one document and stay or go together.
    """
    gone = near_copies(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
