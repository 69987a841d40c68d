import random
import re

import numpy as np
import xxhash

from edges import empty_documents, odd_documents
from plumbline.llm import components, simhash


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(ids, prints, radius=4):
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                label[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return [ids[root(i)] for i in range(len(ids))]


def balls(rng, centres=6, members=40, singles=120):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(members):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            out.append(x)
    return out + [rng.getrandbits(64) for _ in range(singles)]


def test_fingerprints(spark):
    docs = odd_documents(spark)
    found = {(r["doc_id"], r["fp"] % (1 << 64)) for r in simhash.fingerprints(docs).collect()}
    assert found == {(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()}


def test_tree_search():
    rng = random.Random(4)
    fps = np.array(sorted(set(balls(rng))), np.uint64)
    q, node = simhash.Tree(fps).search(fps, 4)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    assert set(zip(q.tolist(), node.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_links_give_the_components(spark):
    rng = random.Random(9)
    fps = sorted(set(balls(rng)))
    ids = list(range(100, 100 + len(fps)))
    rng.shuffle(ids)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame(list(zip(signed, ids)), "fp long, rep long").repartition(3)
    found = dict(components.roots(simhash.near_links(frame)).collect())
    assert [found.get(i, i) for i in ids] == brute_components(ids, fps)
    small = fps[:20]
    assert len(simhash._small_links(small, 4)) == len(small) - len(set(brute_components(ids[:20], small)))


def hot_shard(rng, members=400, singles=60):
    """Fingerprints of which most differ from one in a few of the bits above the first two blocks, so one shard holds them."""
    c = rng.getrandbits(64)
    out = [rng.getrandbits(64) for _ in range(singles)]
    for _ in range(members):
        x = c
        for b in rng.sample(range(22, 64), rng.randint(0, 9)):
            x ^= 1 << b
        out.append(x)
    return sorted(set(out))


def test_large_shards_meet_in_pieces(spark):
    rng = random.Random(12)
    fps = hot_shard(rng)
    ids = list(range(len(fps)))
    rng.shuffle(ids)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame(list(zip(signed, ids)), "fp long, rep long").repartition(3)
    dealt = simhash.dealt_to_shards(frame, shard=90)
    sizes = [r["count"] for r in dealt.groupBy("pair", "value", "i", "j").count().collect()]
    assert max(sizes) < 2 * 90 and sum(sizes) > 15 * len(fps)
    found = dict(components.roots(simhash.near_links(frame, shard=90)).collect())
    expected = brute_components(ids, fps)
    assert [found.get(i, i) for i in ids] == expected and 1 < len(set(expected)) < len(ids)


def test_large_links_stop_when_all_are_seen():
    fps = np.array(hot_shard(random.Random(5), 300, 0), np.uint64)
    linked = [(b, a) for a, b in simhash._large_links(fps, 4)]
    group = dict(linked)
    assert len(group) == len(linked)
    label = [group.get(i, i) for i in range(len(fps))]
    assert label == brute_components(list(range(len(fps))), fps.tolist())


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    rng.shuffle(edges)
    found = dict(components.roots(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(1, 61)}, **{k: 100 for k in range(101, 160)}, 201: 200}
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    near = base[:200] + ["changed"] + base[201:]
    texts = [" ".join(base).upper(), " ".join(near), " ".join(base), "other words entirely here now", "", None]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    rows = {r["doc_id"]: r for r in simhash.component_rows(docs).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    expected = brute_components(list(range(6)), prints)
    assert [(rows[i]["fingerprint"], rows[i]["component_id"]) for i in range(6)] == [
        (f"{p:016x}", c) for p, c in zip(prints, expected)
    ]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected))


def test_edges(spark):
    docs = odd_documents(spark)
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
    lost = docs.filter("doc_id IS NULL")
    assert simhash.near_duplicates(lost).first()["component_id"] is None and simhash.keep_first(lost).count() == 1
