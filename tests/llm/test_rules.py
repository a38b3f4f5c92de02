import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import rules

from .util import SF, crowded, empty_docs, empty_labels, odd_docs, odd_labels, odd_rows, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for k, w in enumerate(windows) if often[w] > 1 for j in (k, k + 1, k + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


@pytest.mark.parametrize("case", ["odd", "table"])
def test_base_columns(spark, case):
    docs = odd_docs(spark) if case == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    labels = odd_labels(spark) if case == "odd" else spark.read.parquet(f"{SF}/labels.parquet")
    pairs = [(r[0], r[1]) for r in odd_rows()] if case == "odd" else [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = rows_of(rules.judged(docs, labels))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in rows) == sorted((str(i), *brute(t)) for i, t in pairs)
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_ratio_tells_good_from_bad(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r["doc_id"]: r for r in rows_of(rules.judged(docs, labels))}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    passed = [(r["kept"], quality[i]) for i, r in rows.items() if i in quality and not r["base_failed"]]
    good, bad = [k for k, q in passed if q == 1], [k for k, q in passed if q == 0]
    assert sum(good) >= 0.97 * len(good)
    if bad:
        assert sum(bad) <= 0.7 * len(bad) + 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def brute_buckets(text, buckets: int) -> list[int]:
    """Buckets of words and of pairs of words, by XXH64 as the engine has it: seed 42, a pair's first hash seeds its second."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    raw = [x.to_bytes(8, "little") for x in h]
    pairs = [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(raw, raw[1:])]
    return [signed(x) % buckets for x in [*h, *pairs]]


@pytest.mark.parametrize("case", ["odd", "table"])
def test_ratio_and_verdict_by_hand(spark, case):
    docs = odd_docs(spark) if case == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    labels = odd_labels(spark) if case == "odd" else spark.read.parquet(f"{SF}/labels.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    good, b = {r["doc_id"] for r in labels.collect() if r["quality"] == 1} - {None}, rules.BUCKETS
    raw, target = Counter(), Counter()
    for i, text in pairs:
        own = brute_buckets(text, b)
        raw.update(own)
        if i in good:
            target.update(own)
    t, r = sum(target.values()), sum(raw.values())
    want = []
    for i, text in pairs:
        own = brute_buckets(text, b)
        ratio = sum(math.log((target[x] + 1) / (t + b)) - math.log((raw[x] + 1) / (r + b)) for x in own) / len(own) if own and t else 0.0
        want.append((str(i), round(ratio, 9), not brute(text)[-1] and ratio >= rules.THRESHOLD))
    rows = rows_of(rules.judged(docs, labels))
    assert sorted((str(x["doc_id"]), round(x["ratio"], 9) + 0.0, x["kept"]) for x in rows) == sorted((i, x + 0.0, k) for i, x, k in want)
    assert {x["kept"] for x in rows} == {True, False} and t


def test_clashing_columns(spark):
    rows = rows_of(rules.judged(crowded(odd_docs(spark)).withColumn("_h", F.lit(1)).withColumn("ratio", F.lit("mine")), odd_labels(spark).withColumn("text", F.lit("x"))))
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["ratio"], r["kept"])
    assert sorted(map(key, rows)) == sorted(map(key, rows_of(rules.judged(odd_docs(spark), odd_labels(spark)))))


def test_same_text_same_verdict(spark):
    docs, labels = odd_docs(spark), odd_labels(spark)
    rows = rows_of(rules.judged(docs, labels))
    texts = {}
    for r, (i, t, *_) in zip(sorted(rows, key=lambda r: (str(r["doc_id"]), r["n_words"])), sorted(odd_rows(), key=lambda r: (str(r[0]), len(WORD.findall(r[1] or ""))))):
        texts.setdefault((t or "").strip(), set()).add(round(r["ratio"], 9))
    assert all(len(v) == 1 for v in texts.values())
    assert rules.log_ratios([0, 0], [3, 4]) == [0.0, 0.0]


def test_empty(spark):
    assert rules.judged(empty_docs(spark), empty_labels(spark)).count() == 0
    rows = rows_of(rules.judged(odd_docs(spark), empty_labels(spark)))
    assert all(r["ratio"] == 0 and r["kept"] == (not r["base_failed"]) for r in rows)
