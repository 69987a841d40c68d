import math
import re
from collections import Counter

from edges import empty_documents, odd_documents
from plumbline.llm import search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=50):
    """(item_id, rank, doc_id, score) of every query against every document."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 50 + (50 * sum(c.values()) * len(counts)) // total
            weight = lambda w: math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[w] + 1)))
            score = sum(weight(w) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        found.sort(key=lambda f: f[:3])
        out += [(item, i, f[3], -f[0]) for i, f in enumerate(found[:top], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def below(part, n, nodes):
    return [part] if part < n else [t for p in nodes[part - n] for t in below(p, n, nodes)]


def test_plan_adds_each_term_once():
    queries = [[0, 1, 2, 3], [1, 2, 3, 4], [1, 2, 5], [6], [], [3, 2, 1, 0], list(range(7))]
    nodes, roots = search.sharing_plan(queries, 7)
    for q, parts in zip(queries, roots, strict=True):
        assert sorted(t for p in parts for t in below(p, 7, nodes)) == sorted(q)
    additions = sum(max(0, len(p) - 1) for p in nodes + roots)
    assert additions < sum(max(0, len(q) - 1) for q in queries)


def test_long_queries_are_paired_in_pieces(monkeypatch):
    monkeypatch.setattr(search, "PAIRED_PARTS", 3)
    queries = [[t for t in range(40) if t % k] for k in (2, 3, 5, 7)] * 2
    nodes, roots = search.sharing_plan(queries, 40)
    for q, parts in zip(queries, roots, strict=True):
        assert sorted(t for p in parts for t in below(p, 40, nodes)) == q


def test_brute_force_on_odd_tables(spark):
    docs = odd_documents(spark)
    items = [(1, "The WORD1 of word2, word1!"), (1, "one two"), (None, "é row x日本語"), (2, None), (3, ""), (4, "absent"), (5, "a name")]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score long")
    assert rows(search.search(docs, asked, top=4)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], items, 4)


def test_blocks_and_groups_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(5)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(6)
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert rows(search.search(docs, items)) == want
    monkeypatch.setattr(search, "BLOCK_TERMS", 90)
    monkeypatch.setattr(search, "GROUP_TERMS", 50)
    assert rows(search.search(docs, items)) == want


def test_equal_scores_go_by_doc_id(spark):
    docs = spark.createDataFrame([(i % 40, "same words here") for i in range(400)] + [(99, "else")], "doc_id long, text string")
    found = rows(search.search(docs.repartition(7), spark.createDataFrame([(1, "words")], "item_id long, text string")))
    assert sorted((r[1], r[2]) for r in found) == [(i + 1, i // 10) for i in range(50)]


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert search.search(empty_documents(spark), items).count() == 0
    assert search.search(odd_documents(spark), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
