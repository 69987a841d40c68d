import random
import re

from edges import empty_documents, odd_documents
from plumbline.llm import licenses as L


def brute(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        q = phrase.split()
        for i in range(len(words) - len(q) + 1):
            if words[i : i + len(q)] == q:
                places.append(i)
                labels.add(label)
    ends = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *ends, ",".join(sorted(labels))


MIT = (
    "Copyright (c) 2020 Somebody\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
)
TEXTS = [
    "x Apache-License y the GNU General\nPublic License; gnu general public  license. CC BY-NC 4.0, cc-by",
    "gnu general public", "license apache", "the mit licensex mit license\x7f mit\x80license", MIT, "word " * 3000 + MIT,
    "Licensed under CC BY-NC 4.0.", "permission granted to copy software rights", "apache", "license",
]


def test_base_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").union(
        odd_documents(spark).filter("doc_id > 3").selectExpr("doc_id + 100", "text")
    )
    found = {r["doc_id"]: tuple(r) for r in L.scan(docs).collect()}
    for r in docs.collect():
        assert found[r["doc_id"]][1:6] == brute(r["text"]), r["doc_id"]


def test_templates(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    by = {r["doc_id"]: r for r in L.scan(docs).collect()}
    assert by[4]["labels"] == by[5]["labels"] == "mit" and by[4]["score"] > 0.6 and by[4]["base_labels"] == ""
    assert by[6]["labels"] == "cc-by,cc-by-nc" and by[6]["score"] == 1
    assert by[7]["labels"] == by[8]["labels"] == "" and by[7]["score"] < 0.6
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in by.values())


BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:"
)
NAMED = {
    BSD: "bsd",
    "3. Neither the name of the University of Somewhere nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.": "bsd-3",
    "// SPDX-License-Identifier: MIT\nint main() {}": "mit",
    "# SPDX-License-Identifier: GPL-2.0-only": "gpl",
    "# SPDX-License-Identifier: BSD-3-Clause": "bsd-3",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0": "epl",
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License).": "cddl",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions:": "zlib",
    "To the extent possible under law, Jo Doe has waived all copyright and related or neighboring rights to this work.": "cc0",
    "Distributed under the Boost Software License, Version 1.0.": "boost",
    "the SPDX license identifier is missing here": "",
    "source code forms may be used with or without modification": "",
}


def test_notices_and_tags(spark):
    texts = list(NAMED)
    texts += ["lead word " * 400 + t + " more words" * 300 for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.scan(rows).collect():
        want = NAMED[texts[r["doc_id"] % len(NAMED)]]
        assert r["labels"] == want and r["base_labels"] == "", texts[r["doc_id"]]
        assert r["score"] >= L.SIMILARITY if want else 0 < r["score"] < L.SIMILARITY


def brute_shares(words, idf, anchored=True):
    """Per template, the best weight of different indexed positions whose shifts lie in one window, with an anchor there."""
    out = {}
    for t, template in enumerate(L.TEMPLATES):
        parts = template.text.split()
        rare = sorted(set(parts), key=lambda w: (-idf[w], w))[: L.RARE_WORDS]
        total = sum(idf[w] for w in rare)
        anchors = {w for k, w in enumerate(rare) if sum(idf[v] for v in rare[:k]) <= (1 - L.SIMILARITY + 1e-9) * total}
        for move in (0, L.DRIFT // 2):
            cells = {}
            for p, w in enumerate(parts):
                for at, v in enumerate(words):
                    if w in rare and v == w:
                        cells.setdefault((at - p + move) // L.DRIFT, set()).add(p)
            for positions in cells.values():
                if anchored and not any(parts[p] in anchors for p in positions):
                    continue
                share = sum(idf[parts[p]] / total / parts.count(parts[p]) for p in positions)
                out[t] = max(out.get(t, 0.0), min(1.0, share))
    return out


def test_alignment_against_brute_force():
    rng = random.Random(2)
    names = L.vocabulary()[0]
    idf = {w: rng.uniform(1, 9) for w in names}
    texts = [t for t in TEXTS if len(t) < 2000]
    for template in L.TEMPLATES:
        parts = template.text.split()
        for _ in range(3):  # words lost, put in and changed
            kept = [w if rng.random() > 0.1 else rng.choice(["name", w + " of", ""]) for w in parts]
            texts.append("x " * rng.randrange(9) + " ".join(kept[rng.randrange(3) :]))
    index = L.Index(idf)
    for text in texts:
        words = L.Words([text])
        ids = L.known(words)
        _, templates, shares = index.candidates(words, ids)
        want = brute_shares([w.decode() for w in words.text(0, len(ids))], idf)
        assert {t: round(v, 9) for t, v in zip(templates.tolist(), shares.tolist())} == {t: round(v, 9) for t, v in want.items()}
        strong = {t for t, v in brute_shares([w.decode() for w in words.text(0, len(ids))], idf, False).items() if v >= L.SIMILARITY}
        assert strong == {t for t, v in want.items() if v >= L.SIMILARITY}


def test_batches_do_not_matter(spark):
    texts = [t for t in NAMED for _ in range(2)] + TEXTS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = L.corpus_idf(docs)
    assert sorted(L.scan(docs.repartition(9), idf).collect()) == sorted(L.scan(docs.coalesce(1), idf).collect())


def test_weights_count_all_texts(spark):
    docs = spark.createDataFrame([(i, "the license" if i % 2 else "the gnu the") for i in range(40)], "doc_id long, text string")
    idf = L.corpus_idf(docs.repartition(5))
    assert idf == L.idf_of({"the": 40, "license": 20, "gnu": 20}, 40)


def test_edges(spark):
    docs = odd_documents(spark)
    rows = L.scan(docs).collect()
    assert len(rows) == docs.count() and all(r["labels"] == "" and r["first_word"] is None for r in rows)
    assert L.scan(empty_documents(spark)).count() == 0
