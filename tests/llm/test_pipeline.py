import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edges import empty_documents, odd_documents
from plumbline.llm import quality
from plumbline.llm.tokens import Encoder, default_vocabulary
from test_near_copies import brute, shingle_set

SF = "/root/testdata/sf0.001"


def stages(spark, docs, sf=SF):
    """Each stage's rows, every one on all its predecessor kept."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def made(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, stages(spark, docs)


def test_columns(made):
    docs, out = made
    assert all(x.columns == docs.columns for x in out[:-1])


def test_quality_keeps_what_sql_keeps(made):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = con.execute(f"SELECT doc_id FROM ({quality.QUALITY_SQL}) WHERE kept").fetchall()
    assert sorted(r["doc_id"] for r in made[1][0].collect()) == sorted(k for (k,) in kept)


def test_one_document_of_each_group_stays(made):
    rows = sorted(made[1][0].collect(), key=lambda r: r["doc_id"])
    ids = [r["doc_id"] for r in rows]
    groups = brute([shingle_set(r["text"]) for r in rows], ids)
    assert sorted(r["doc_id"] for r in made[1][1].collect()) == sorted(set(groups.values()))


def test_passages_go_and_clean_documents_stay(made):
    con = duckdb.connect()
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [words(t) for (t,) in con.execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    before, after = ({r["doc_id"]: words(r["text"]) for r in x.collect()} for x in made[1][1:3])
    gone = set(before) - set(after)
    holds = lambda ws, item: any(ws[i : i + len(item)] == item for i in range(len(ws) - len(item) + 1))
    assert gone == {k for k, ws in before.items() if any(holds(ws, item) for item in items)}


def test_personal_data_and_packing(made):
    _, (*_, clean, private, packed) = made
    old, new = ({r["doc_id"]: r for r in x.collect()} for x in (clean, private))
    assert set(old) == set(new) and all(r["n_chars"] == len(r["text"]) for r in new.values())
    mail = re.compile(r"[\w.]+@[\w.]+\.com")
    changed = [k for k in old if old[k]["text"] != new[k]["text"]]
    assert all(not set(mail.findall(old[k]["text"])) & set(mail.findall(new[k]["text"])) for k in changed)
    coder, pieces = Encoder(default_vocabulary()), {}
    for r in packed.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    for k, r in new.items():
        ids = np.array(coder.library.encode(r["text"], add_special_tokens=False).ids + [0], "<u4")
        own = sorted(pieces[k], key=lambda p: p["start"])
        assert [p["ids_crc32"] for p in own] == [zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in own]
        assert sum(p["length"] for p in own) == len(ids)


def test_clashing_columns_stay(spark):
    """Columns named as the stages' helpers and counts, through the stages that keep the table's columns."""
    names = ["_words", "_pairs", "_kept", "_found", "_marked", "n_card", "n_words", "kept", "component_id", "leaked"]
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = plain.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    odd = stages(spark, docs)
    for mine, theirs in zip(odd[:-1], stages(spark, plain)[:-1], strict=True):
        assert mine.columns == docs.columns
        rows = mine.collect()
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in theirs.collect())


def test_run_and_edges(spark, made):
    assert corpus_pipeline.run(spark, SF).count() == made[1][-1].count()
    docs = odd_documents(spark).withColumnRenamed("n_words", "n_chars")
    assert stages(spark, docs)[0].columns == docs.columns
    none = empty_documents(spark).selectExpr("*", "'s' AS source", "1L AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
