import random

import duckdb
import numpy as np

import corpus_pipeline
from edges import empty_documents, odd_documents
from plumbline.llm import near_copies as N
from plumbline.llm.components import roots
from plumbline.llm.simhash import near_links


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(sets, ids):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return dict(zip(ids, (ids[x] for x in label)))


def made(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["component_id"] for r in N.near_copies(rows).collect()}


def test_near_copies_go_from_the_pipeline(spark):
    """Pairs of 0.8 and more that differ in more than four bits of their SimHash."""
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{path}' WHERE length(text) > 120 ORDER BY doc_id").fetchall()
    docs = spark.createDataFrame([(i, t, 's', len(t)) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    want = brute([shingle_set(t) for _, t in rows], [i for i, _ in rows])
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_edited_copies(spark, monkeypatch):
    rng, texts = random.Random(3), []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(30, 300))]
        for edits in (0, 1, 2, 4, 8):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"x{rng.randrange(500)}"
            texts.append(" ".join(words))
    want = brute([shingle_set(t) for t in texts], list(range(len(texts))))
    assert made(spark, texts) == want
    monkeypatch.setattr(N, "PIECE", 200)
    assert made(spark, texts) == want


def test_links_of_many_sets():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 10**6, 90).astype(np.uint64)) for _ in range(4)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.95], rng.integers(0, 10**6, 3).astype(np.uint64)])) for b in base for _ in range(30)]
    want = brute([set(s.tolist()) for s in sets], list(range(len(sets))))
    label = list(range(len(sets)))
    for a, b in N.set_links(sets):
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    assert dict(enumerate(label)) == want


def test_edges(spark):
    docs = odd_documents(spark)
    assert N.near_copies(docs).count() == docs.count()
    assert N.keep_first(docs).columns == docs.columns
    assert N.near_copies(empty_documents(spark)).count() == 0


def test_a_key_of_many_different_sets_leaves_a_batch_once():
    import pyarrow as pa

    keys = [[7] * N.BANDS, [7] * (N.BANDS - 1) + [9], [9] * N.BANDS, [5] * N.BANDS]
    batch = pa.record_batch({"fp": pa.array([30, 10, 20, 40], pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64()))})
    (out,) = N._batch_links([batch])
    rows = sorted((r["to"] is not None, r["key"], r["fp"], r["to"] or 0) for r in out.to_pylist())
    assert rows == [(False, 5, 40, 0), (False, 7, 10, 0), (False, 9, 10, 0), (True, 20, 20, 10), (True, 30, 30, 10)]
    more = pa.record_batch({"key": pa.array([7, 8], pa.int64()), "fp": pa.array([50, 60], pa.int64()), "to": pa.array([None, 50], pa.int64())})
    first = pa.record_batch({"key": pa.array([7], pa.int64()), "fp": pa.array([10], pa.int64()), "to": pa.array([None], pa.int64())})
    links = [(r["a"], r["b"]) for b in N._key_links([first, more]) for r in b.to_pylist()]
    assert sorted(links) == [(50, 10), (60, 50)]


def test_components_with_hubs_and_chains(spark):
    """Hubs above a thousandth of the edges meet their minimum in a broadcast, other nodes in a join."""
    rng = random.Random(5)
    edges = [(5000, 5001 + i) for i in range(900)] + [(20_000 + i, 4000) for i in range(700)]
    edges += [(30_000 + i, 30_001 + i) for i in range(40)] + [(40_000 + 2 * i, 40_001 + 2 * i) for i in range(1500)]
    rng.shuffle(edges)
    found = {r["node"]: r["root"] for r in roots(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = {5001 + i: 5000 for i in range(900)} | {20_000 + i: 4000 for i in range(700)}
    want |= {30_001 + i: 30_000 for i in range(40)} | {40_001 + 2 * i: 40_000 + 2 * i for i in range(1500)}
    assert found == want


def test_candidates_come_from_simhash_trees(spark, monkeypatch):
    """Links of equal and of near fingerprints, and the stage asks for them."""
    rng, texts = random.Random(8), []
    for _ in range(6):
        base = [f"w{rng.randrange(900)}" for _ in range(400)]
        for k in range(4):
            texts.append(" ".join([*base, *(f"x{rng.randrange(900)}" for _ in range(k))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = N.sketches(docs).filter("sim IS NOT NULL").select("fp", "sim").distinct()
    sims = {r["fp"]: r["sim"] % (1 << 64) for r in rows.collect()}
    fps = sorted(sims)
    assert all(v == N.majority(N.votes(h := N.hashes(t)), len(h)) for t in texts for v in [sims[N._print(N.hashes(t))]])
    label = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (sims[a] ^ sims[b]).bit_count() <= 4 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {f: new if x == old else x for f, x in label.items()}
    assert len(set(label.values())) < len(fps)
    found = {r["node"]: r["root"] for r in roots(N.sim_links(rows)).collect()}
    assert {f: found.get(f, f) for f in fps} == label

    same = spark.createDataFrame([(7, 5), (9, 5), (8, 5), (3, -1)], "fp long, sim long")
    assert {r["node"]: r["root"] for r in roots(N.sim_links(same)).collect()} == {8: 7, 9: 7}
    asked = []
    monkeypatch.setattr(N, "near_links", lambda distinct: asked.append(1) or near_links(distinct))
    corpus_pipeline.simhash_near_dedup(spark, docs.limit(4), "").count()
    assert asked


def test_a_star_step_has_a_short_plan(spark, monkeypatch):
    from plumbline.llm import components

    scans, write = [], components.written

    def counted(df, name, *more):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return write(df, name, *more)

    monkeypatch.setattr(components, "written", counted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 12)], "a long, b long")
    assert {r["root"] for r in roots(edges).collect()} == {1}
    assert len(scans) > 2 and 0 < max(scans) <= 12, scans
