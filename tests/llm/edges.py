"""Small tables that every operator must take: nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

ALL = "doc_id long, text string, n_words long, score double, kept string, component_id string, fp string, offset string"


def odd_documents(spark, parts: int = 3):
    long_line = " ".join(f"word{i % 997} of the" for i in range(6000))
    texts = [
        (0, None), (1, ""), (2, "  \n\t "), (3, "one two three"), (3, "one two three"), (None, "a row without a name"),
        (4, long_line), (5, long_line), (6, "x" * 5000), (7, "é" * 60 + " 日本語 ½ Ⅷ"), (8, None), (9, "\x00\x1c odd \x85 bytes"),
    ]
    rows = [(i, t, 1, 0.5, "x", "x", "x", "x") for i, t in texts]
    return spark.createDataFrame(rows, ALL).repartition(parts)


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
