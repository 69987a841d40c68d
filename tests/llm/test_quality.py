import re
from collections import Counter

import pytest
from compare import connect, differences

from edges import empty_documents, odd_documents
from plumbline.llm import quality, queries

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 8)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_counts_against_brute_force(spark):
    docs = odd_documents(spark)
    found = Counter(tuple(r)[:6] for r in quality.quality_rows(docs).collect())
    assert found == Counter((r["doc_id"], *brute(r["text"])) for r in docs.collect())


@pytest.mark.parametrize("sf", [SF])
def test_sql(spark, sf):
    assert differences(queries.QUERIES["op2_quality_rules"](spark, sf), connect(sf), quality.QUALITY_SQL) == []


def test_rules(spark):
    prose = " ".join(["the", "river", "ran", "to", "sea", "and", "we", "saw", "it", "from"] + [f"w{i}or" for i in range(20)])
    texts = [prose, prose.upper() + "!!", "### $$$ " * 15 + prose, "alpha beta gamma " * 30, "short text"]
    rows = quality.quality_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    by = {r["doc_id"]: r for r in rows.collect()}
    assert by[0]["kept"] and not any(by[i]["kept"] for i in (1, 2, 3, 4))
    assert "capitals" in by[1]["failed"] and "symbols" in by[2]["failed"]
    assert by[3]["base_failed"] and by[4]["base_failed"] and not by[1]["base_failed"]


def test_filter_keeps_columns_and_rows(spark):
    docs = odd_documents(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert quality.keep_good(empty_documents(spark)).count() == 0
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") <= 2
