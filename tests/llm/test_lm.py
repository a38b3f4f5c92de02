import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import blobs, lm

from .util import SF, crowded, empty_docs, odd_docs, odd_rows, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(AZ)), None]


def hold(rows, docs):
    held = lambda i: i is not None and crc32(str(i).encode()) % 7 == 2
    counts = Counter(t for i, text in docs if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in docs:
        own = tokens(text)
        want.append((str(i), held(i), len(own), sum(counts[t] > 0 for t in own), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 5)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows) == sorted(want)
    for r in rows:
        assert r["score"] < 0 or r["score"] == 0 == r["train_tokens"]
        assert math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"]), rel_tol=1e-9)


def test_counts_and_base(spark):
    hold(rows_of(lm.scored(odd_docs(spark))), [(r[0], r[1]) for r in odd_rows()])
    assert lm.scored(empty_docs(spark)).count() == 0


def test_table_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = rows_of(lm.scored(docs))
    hold(rows, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.97
    again = {r["doc_id"]: r["score"] for r in rows_of(lm.scored(docs.repartition(5)))}
    assert all(math.isclose(again[r["doc_id"]], r["score"], rel_tol=1e-9) for r in rows)


def test_seen_pairs_beat_unknown_words(spark):
    train = [(k, "a b a c b") for k in range(40) if crc32(str(k).encode()) % 7 != 2]
    probes = [k for k in range(100, 400) if crc32(str(k).encode()) % 7 == 2][:3]
    rows = {r["doc_id"]: r for r in rows_of(lm.scored(spark.createDataFrame([*train, *zip(probes, ["a b", "a c", "a zzz"])], "doc_id long, text string")))}
    assert all(rows[p]["held_out"] for p in probes)
    assert rows[probes[0]]["score"] > rows[probes[2]]["score"] < rows[probes[1]]["score"]


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(8)
    for d in (0.05, 0.5, 0.9):
        c = rng.integers(1, 400, 60).astype(float)
        base = rng.random(100)
        base /= base.sum()
        t = lm.seat(c, base[:60], np.full(60, 60.0), d, lm.STRENGTH, rng)
        c, t = np.append(c, np.zeros(40)), np.append(t, np.zeros(40))
        p = lm.predictive(c, t, base, c.sum(), t.sum(), d)
        assert (p > 0).all() and abs(p.sum() - 1) < 1e-12


def test_seating():
    """Tables follow the Chinese restaurant: one dish alone, base 1, has the known mean number of tables."""
    rng, c, d, h = np.random.default_rng(3), 12, 0.5, 1.0
    mean = 1.0
    exact = 1.0
    for i in range(1, c):
        exact += (h + d * exact) / (h + i)
    runs = [lm.seat(np.array([float(c)]), np.array([1.0]), np.array([0.0]), d, h, rng)[0] for _ in range(4000)]
    mean = float(np.mean(runs))
    assert abs(mean - exact) < 0.15, (mean, exact)
    t = lm.seat(np.array([1.0, 2.0, 500.0, 100000.0]), np.full(4, 0.25), np.zeros(4), d, h, rng)
    assert (t >= 1).all() and (t <= [1, 2, 500, 100000]).all()


def sent_on(fn, *inboxes):
    """What a stage makes of each key's blobs, by key and kind."""
    whole: dict = {}
    for inbox in inboxes:
        for key, held in inbox.items():
            for kind, packed in held.items():
                whole.setdefault(key, {}).setdefault(kind, []).extend(packed)
    out: dict = {}
    for key in sorted(whole):
        for batch in fn(key, whole[key]):
            for to, kind, blob in zip(*batch.to_pydict().values()):
                out.setdefault(to, {}).setdefault(kind, []).append(blob)
    return out


def only(sent, *kinds):
    return {key: {kind: packed for kind, packed in held.items() if kind in kinds} for key, held in sent.items()}


def tally(sent, size):
    out = np.zeros(size, np.int64)
    for held in sent.values():
        for blob in held.get(lm.TALLY, []):
            np.add.at(out, *blobs.unpack(blob, np.int64, np.int64))
    return out


def in_groups(texts, groups):
    return {g: {lm.TEXTS: [blobs.pack_rows(pa.RecordBatch.from_pydict({"doc_id": [*range(g, len(texts), groups)], "text": texts[g::groups]}))]} for g in range(groups)}


def scores_of(texts, groups, heavy=(lm.START,)):
    """The plan of `scored` with dictionaries for shuffles: score of each text, and the tables of each round."""
    heavy = np.array(sorted(heavy), np.uint64)
    held = in_groups(texts, groups)
    start = sent_on(lm._start(groups, heavy), sent_on(lm._ask(groups, heavy), held))
    n, v, n1, n2, *hot = tally(start, 4 + 2 * len(heavy)).tolist()
    once, more = np.array(hot[: len(heavy)]), np.array(hot[len(heavy) :])
    d, d0, root, sent, contexts, roots, tables, samples = lm._discount(n1, n2), 0.5, None, only(start, lm.SENT), {}, [], [], []
    for r in range(lm.ROUNDS + 1):
        rooted = sent_on(lm._seat_root(groups, r, d0, v, root), only(start, lm.ONCE, lm.DISHES), sent, only(rooted, lm.ROOT_SEATS) if r else {})
        c0, t0, m1, m2 = tally(rooted, 4).tolist()
        root, d0 = lm.Root(d0, c0, t0, v), lm._discount(m1, m2)
        if r > lm.ROUNDS - lm.SAMPLES:
            roots.append(root)
            tables.append(once + more)
            samples.append(only(rooted, lm.KEPT))
        if r == lm.ROUNDS:
            break
        contexts = sent_on(lm._seat_contexts(groups, r + 1, d, root, once + more), only(start, lm.FIXED, *([lm.ASKERS] if r + 1 == lm.ROUNDS else [])), only(rooted, lm.BASES), only(contexts, lm.SEATS))
        more, sent = tally(contexts, len(heavy)), only(contexts, lm.SENT)
    known = sent_on(lm._answer_words, only(start, lm.VOCABULARY, lm.WORD_ASKERS), *samples)
    answers = [only(start, lm.COUNTS, lm.WORD_COUNTS), only(contexts, lm.TABLES), known]
    out: dict = {}
    score = lm._score(groups, heavy, lm.Model(n, v, d, tuple(roots), np.array(tables)))
    for g in held:
        inbox = {**held[g]}
        for sent in answers:
            for kind, packed in sent.get(g, {}).items():
                inbox.setdefault(kind, []).extend(packed)
        for batch in score(g, inbox):
            out.update(zip(batch.column(0).to_pylist(), batch.column("score").to_pylist()))
    return [out[k] for k in range(len(texts))]


def plain_scores(texts, rounds, burn, seed):
    """A sampler that seats one customer after the other, context and root together, with predictive probabilities averaged."""
    rng = random.Random(seed)
    streams = [[None, *tokens(t)] for t in texts]
    train = [(a, b) for i, s in enumerate(streams) if crc32(str(i).encode()) % 7 != 2 for a, b in zip([("start",), *s[1:]], s[1:])]
    pair_counts = Counter(train)
    v = len({w for _, w in train})
    d = lm._discount(sum(c == 1 for c in pair_counts.values()), sum(c == 2 for c in pair_counts.values()))
    h, d0 = lm.STRENGTH, 0.5
    rest: dict = {}  # context -> dish -> customers of each table
    root: dict = {}

    def seats(tables, c, t_all, base, dish, disc):
        own = tables.setdefault(dish, [])
        weights = [max(n - disc, 0) for n in own] + [(h + disc * t_all) * base]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(own):
            own.append(1)
            return True
        own[k] += 1
        return False

    def leaves(tables, dish):
        own = tables[dish]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            del own[k]
            return True
        return False

    number: dict = {}
    root_n = {"c": 0, "t": 0}

    def p0(w):
        own = root.get(w, [])
        return (sum(own) - d0 * len(own) + (h + d0 * root_n["t"]) / (v + 1)) / (h + root_n["c"])

    def add(u, w):
        n = number.setdefault(u, [0, 0])
        if seats(rest.setdefault(u, {}), n[0], n[1], p0(w), w, d):
            n[1] += 1
            root_n["t"] += seats(root, root_n["c"], root_n["t"], 1 / (v + 1), w, d0)
            root_n["c"] += 1
        n[0] += 1

    def drop(u, w):
        n = number[u]
        if leaves(rest[u], w):
            n[1] -= 1
            root_n["t"] -= leaves(root, w)
            root_n["c"] -= 1
        n[0] -= 1

    for u, w in train:
        add(u, w)
    every, kept = [np.zeros(len(s) - 1) for s in streams], 0
    for r in range(rounds):
        for u, w in train:
            drop(u, w)
            add(u, w)
        sums = [sum(own) for own in root.values() if own]
        d0 = lm._discount(sums.count(1), sums.count(2))
        if r >= burn:
            kept += 1
            for p, s in zip(every, streams):
                for k, (u, w) in enumerate(zip([("start",), *s[1:]], s[1:])):
                    own, n = rest.get(u, {}).get(w, []), number.get(u, [0, 0])
                    p[k] += (sum(own) - d * len(own) + (h + d * n[1]) * p0(w)) / (h + n[0])
    return [float(np.log10(p / kept).sum()) for p in every]


def zipf_texts(n=150, seed=4):
    rng = np.random.default_rng(seed)
    follow = rng.permutation(40)
    texts = []
    for _ in range(n):
        words, w = [], 0
        for _ in range(60):
            w = int(follow[w % 40]) if rng.random() < 0.5 else int(min(rng.zipf(1.6), 300))
            words.append(f"w{w}")
        texts.append(" ".join(words))
    return texts


def test_scores_equal_a_plain_sampler():
    """Mean scores lie within what two plain samplers with other seeds differ by, or half a per cent."""
    texts = zipf_texts(80)
    plain = [np.array(plain_scores(texts, 14, 6, seed)) for seed in (1, 2)]
    ours = np.array(scores_of(texts, 3))
    held = np.array([crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))])
    for part in (held, ~held):
        want, spread = (plain[0] + plain[1])[part].mean() / 2, abs((plain[0] - plain[1])[part].mean())
        assert abs(ours[part].mean() - want) < max(spread, 0.005 * abs(want)), (ours[part].mean(), want, spread)
    assert np.corrcoef(ours, plain[0])[0, 1] > 0.995


def test_scores_do_not_depend_on_the_number_of_groups(monkeypatch):
    """Other groups and buckets are other random draws of the same model, with or without contexts dealt out by the pair."""
    texts = zipf_texts()
    heavy = [lm.START, *(xxhash.xxh64_intdigest(f"w{k}".encode()) >> 16 for k in (1, 2, 3))]
    one = np.array(scores_of(texts, 1))
    for groups, hot in ((1, heavy), (7, [lm.START]), (30, heavy)):
        other = np.array(scores_of(texts, groups, hot))
        assert abs(other.mean() / one.mean() - 1) < 0.004 and np.corrcoef(one, other)[0, 1] > 0.998


def test_contexts_are_seated_against_the_root(monkeypatch):
    """The bases of a round are the root's predictive probabilities, the same for any number of groups in the first."""
    texts, seen, seats = zipf_texts(), [], lm.seat
    monkeypatch.setattr(lm, "seat", lambda c, base, *more: seen[-1].append(base) or seats(c, base, *more))
    monkeypatch.setattr(lm, "ROUNDS", 1)
    monkeypatch.setattr(lm, "SAMPLES", 1)
    for groups in (1, 6):
        seen.append([])
        scores_of(texts, groups)
    sums = [sum(len(b) for b in s) for s in seen]
    assert sums[0] == sums[1]
    contexts = seen[0][2]  # after the root's two sweeps of the first round
    assert (contexts > 0).all() and contexts.max() < 1 and len(set(np.round(contexts, 12))) > 20


def test_frequent_contexts_are_dealt_out_and_summed_exactly():
    """Buckets seat parts of one context; its tables are summed over all of them."""
    texts, heavy = [f"w{k}" for k in range(40)], np.array([lm.START], np.uint64)
    start = sent_on(lm._start(3, heavy), sent_on(lm._ask(3, heavy), in_groups(texts, 3)))
    learned = sum(crc32(str(k).encode()) % 7 != 2 for k in range(40))
    assert tally(start, 6).tolist()[4:] == [learned, 0] and sum(lm.COUNTS in held for held in start.values()) == 3


def test_equal_rows_and_clashing_columns(spark):
    """A third of all rows are one text, and columns carry an operator's own names."""
    rows = [(1 if k % 2 else k, "the very same line of words " * 4) for k in range(400)] + [(k, f"text {k} with word{k % 7} and more") for k in range(400, 1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(lm.scored(crowded(docs).withColumn("kind", F.lit("mine")).withColumn("blob", F.lit("mine")).withColumn("n", F.lit("mine"))))
    hold(got, rows)
    same = [r["score"] for r in got if r["n_tokens"] == 25]
    assert len(same) == 400 and max(same) - min(same) < 1e-9
    assert same[0] / 25 > max(r["score"] / r["n_tokens"] for r in got if r["n_tokens"] != 25)
