import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import blobs, suffixes

from .util import SF, crowded, empty_docs, odd_docs, odd_rows, rows_of

N = 50


def brute(docs: list[tuple]) -> list[tuple]:
    """Least id of each window, straight from the definition."""
    least: dict[bytes, int] = {}
    raws = [(i, (t or "").encode()) for i, t in docs]
    for i, raw in raws:
        if i is not None:
            for k in range(len(raw) - N + 1):
                w = raw[k : k + N]
                if least.get(w, i) >= i:
                    least[w] = i
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        if i is not None:
            for k in range(len(raw) - N + 1):
                if least[raw[k : k + N]] < i:
                    gone[k : k + N] = b"\1" * N
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((str(i), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(df))


def planted(seed: int) -> list[tuple]:
    """Texts with shared passages at odd places, runs of one byte, periods, near repeats and tiny alphabets."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(30, 200))) for _ in range(12)]
    passages += ["a" * 120, "ab" * 70, "abc" * 50, "x" * 49, "y" * 50, "é" * 40]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            lo = rng.randrange(max(len(p) - 40, 1))
            parts.append(rng.choice([p, p[lo:], p[: len(p) - lo], "".join(rng.choice("ab") for _ in range(rng.randrange(90)))]))
        docs.append((rng.randrange(90), rng.choice(["", " ", "#", str(i)]).join(parts)))
    return docs


@pytest.mark.parametrize("hot", [suffixes.HOT, 3])
def test_planted(spark, hot):
    docs = planted(hot)
    assert got(suffixes.digests(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot)) == brute(docs)


def test_long_texts_are_taken_in_stretches(monkeypatch):
    """Keys of windows do not depend on where a stretch ends; every window is in one phrase."""
    raw = "".join(t for _, t in planted(11)).encode()
    whole = suffixes.phrases(raw)
    each = lambda p: np.repeat(p[0], p[2])
    for stretch in (1, 7, 50, 333):
        monkeypatch.setattr(suffixes, "STRETCH", stretch)
        cut = suffixes.phrases(raw)
        assert (each(cut) == each(whole)).all() and (cut[1] == np.cumsum(cut[2]) - cut[2]).all()


def test_odd_rows(spark):
    assert got(suffixes.digests(odd_docs(spark))) == brute([(r[0], r[1]) for r in odd_rows()])


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert got(suffixes.digests(docs)) == brute([tuple(r) for r in docs.collect()])


def test_empty(spark):
    assert suffixes.digests(empty_docs(spark)).count() == 0 and suffixes.deduplicated(empty_docs(spark)).count() == 0


def test_stage_keeps_rows_and_columns(spark):
    docs = crowded(odd_docs(spark))
    out = suffixes.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("key <> 'mine' or fp <> 'mine'").count() == 0
    rows = {r["doc_id"]: r for r in rows_of(out) if r["doc_id"] in (5, 6, 1)}
    assert rows[5]["text"] == odd_rows()[6][1] and len(rows[6]["text"]) < 60 and rows[1]["text"] is None


@pytest.mark.parametrize("reach", [1, 5, 50, 10_000])
def test_suffix_order(reach):
    rng = np.random.default_rng(reach)
    for n in range(1, 60):
        for width in (1, 2, 9):
            s = rng.integers(1, width + 1, n)
            order = suffixes.suffix_order(s, reach)
            assert sorted(order.tolist()) == list(range(n))
            cut = [s[i : i + reach].tolist() for i in order]
            assert all(a <= b for a, b in zip(cut, cut[1:]))


def test_suffix_order_of_large_names():
    """Names too wide for three in one integer are named in two steps; the order is the same."""
    rng = np.random.default_rng(9)
    for n in (5, 40, 301):
        s = rng.integers(1, 4, n)
        wide = np.where(s == 3, 1 << 30, s * 1000)
        assert suffixes.suffix_order(wide, n).tolist() == suffixes.suffix_order(s, n).tolist()


def test_least_documents():
    rng = random.Random(6)
    text = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    shared = [text(70) for _ in range(5)]
    pieces = list({text(rng.randrange(20)) + rng.choice(shared)[rng.randrange(10) :] + text(rng.randrange(20)) for _ in range(60)})
    docs = np.array([rng.randrange(40) for _ in pieces])
    windows = [(p[k : k + N], d) for p, d in zip(pieces, docs.tolist()) for k in range(len(p) - N + 1)]
    least: dict = {}
    for w, d in windows:
        least[w] = min(d, least.get(w, d))
    assert suffixes.least_documents(pieces, docs).tolist() == [least[w] for w, _ in windows]


def test_every_removal_comes_from_the_suffix_order(spark, monkeypatch):
    """No window goes that the suffix order of some shard did not give a smaller document."""
    docs = [(i, t) for i, t in planted(7) if t]
    batch = pa.RecordBatch.from_pydict({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs]})
    sent: dict = {}

    def send(made):
        for part in made:
            for key, kind, blob in zip(*part.to_pydict().values()):
                sent.setdefault(kind, {}).setdefault(key, []).append(blob)

    send(suffixes._keys_of_texts(1, 3)(iter([batch])))
    for key, found in sent.pop(0).items():
        send(suffixes._judge_keys(1000)(key, {0: found}))
    texts = [blobs.pack_rows(batch)]
    send(suffixes._ask(3)(0, {0: texts, 1: sent[1][0]}))
    whole, runs = suffixes.least_documents, []
    monkeypatch.setattr(suffixes, "least_documents", lambda *a: runs.append(whole(*a)) or np.full(len(runs[-1]), 1 << 40))
    for key, found in sent[2].items():
        send(suffixes._sort_shards(key, {2: found}))
    rows = suffixes._documents([batch])
    assert suffixes._repeats({3: sent.pop(3, {}).get(0, []), 4: sent[4][0]}, rows) == {}  # had the order found nothing, nothing would go
    monkeypatch.setattr(suffixes, "least_documents", whole)
    for key, found in sent[2].items():
        send(suffixes._sort_shards(key, {2: found}))
    assert suffixes._repeats({3: sent[3][0], 4: sent[4][0]}, rows) and len(runs) == 3


def test_steps_round_trip():
    rng = np.random.default_rng(5)
    for width in (2, 4, 6, 8):
        for x in (rng.integers(0, 1 << min(8 * width, 62), 300), np.zeros(1, np.int64), np.zeros(0, np.int64)):
            assert suffixes._sums(suffixes._steps(x, width), width).tolist() == x.tolist()
    negative = rng.integers(-(1 << 62), 1 << 62, 50)
    assert suffixes._sums(suffixes._steps(negative, 8), 8).tolist() == negative.tolist()
