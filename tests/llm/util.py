"""Inputs that the tests of several operators share."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.001"

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 6000


def odd_rows() -> list[tuple]:
    """Nulls everywhere, empty and very long texts, equal rows, equal ids with other texts, wide characters."""
    rng = random.Random(5)
    words = ["stone", "river", "tree", "Cloud", "night", "ÄPFEL", "naïve", "東京", "🙂", "house", "x", "on", "under"]
    rows: list[tuple] = [
        (1, None, None, None, None),
        (None, "a row without an id " * 8, "en", "b", 160),
        (None, None, None, "b", None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", "a", 4),
        (4, "one", "en", "a", 3),
        (5, LONG, "en", "a", len(LONG)),
        (6, LONG + " tail", "en", "c", None),
        (7, "same text here " * 10, "en", "a", 150),
        (7, "same text here " * 10, "en", "a", 150),
        (7, "another text with the id of two equal rows", "de", "b", 42),
        (-3, "same text here " * 10, "en", "a", 150),
        (9, "\u0000odd▁ bytes\x0b\x0c here\r\n" * 9, "xx", "d", 10),
    ]
    for k in range(20, 60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 140)))
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "c", None]), len(text)))
        if k % 9 == 0:
            rows.append((k + 1000, text, "en", "a", len(text)))
    return rows


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def odd_labels(spark):
    rows = [(k, k % 2, int(k % 5 == 0)) for k in range(20, 60)] + [(20, None, None), (None, 1, 1), (21, 1, None), (999999, 0, 1)]
    return spark.createDataFrame(rows, LABELS)


def crowded(docs):
    """Extra columns whose names clash with what an operator might call its own."""
    from pyspark.sql import functions as F

    for name in ("score", "fp", "key", "size", "_size", "_copies", "_key", "n_words", "ids", "media", "_quality", "u", "v", "w", "root"):
        docs = docs.withColumn(name, F.lit("mine"))
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def empty_labels(spark):
    return spark.createDataFrame([], LABELS)


def rows_of(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
