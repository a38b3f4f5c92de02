import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash

from .util import SF, crowded, empty_docs, odd_docs, odd_rows, rows_of


def brute_print(text) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_groups(prints: list[tuple]) -> list[tuple]:
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), f"{fp:016x}", str(least.get(find(k)))) for k, (i, fp) in enumerate(prints))


def got(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows_of(df))


@pytest.mark.parametrize("case", ["odd", "table"])
def test_documents(spark, case):
    docs = odd_docs(spark) if case == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    pairs = [(r[0], r[1]) for r in odd_rows()] if case == "odd" else [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(simhash.grouped(docs)) == brute_groups([(i, brute_print(t)) for i, t in pairs])


@pytest.mark.parametrize("seed, most", [(1, simhash.MOST), (2, simhash.MOST), (2, 20)])
def test_links_of_crowded_fingerprints(spark, seed, most, monkeypatch):
    """Chains, dense balls and scattered values, so that trees, shards, their parts and components all have work."""
    rng = random.Random(seed)
    values = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    centre = rng.getrandbits(64)
    for _ in range(250):
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
    at = rng.getrandbits(64)
    for _ in range(60):
        at ^= sum(1 << b for b in rng.sample(range(64), rng.choice([2, 4, 4, 5])))
        values.add(at)
    prints = [(k, v) for k, v in enumerate(sorted(values))]
    df = spark.createDataFrame([(k, simhash._signed(v)) for k, v in prints], "doc_id long, fp long")
    whole = simhash.links
    monkeypatch.setattr(simhash, "links", lambda d, radius: whole(d, radius, most))
    classes = {r["fp"]: r["component_id"] for r in rows_of(simhash.classes(df))}
    want = brute_groups(prints)
    assert sorted((str(k), f"{v:016x}", str(classes[simhash._signed(v)])) for k, v in prints) == want


def spanned(n, left, right):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(left, right):
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def same_parts(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b)))


@pytest.mark.parametrize("radius", [0, 1, 4, 9])
def test_trees_and_forest_against_all_pairs(radius):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    one = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 12)]]))
    values, shard = np.concatenate([one, one[:7], one[5:6], one[100:300]]), np.repeat([3, 4, 9, 11], [len(one), 7, 1, 200])
    trees = simhash.BKTrees(values, shard)
    assert (trees.below[trees.roots] == [len(one), 7, 1, 200]).all()
    near = np.flatnonzero(np.bitwise_count(values ^ values[5]) <= radius)
    found = np.concatenate([trees.take(values[5:6], trees.roots[k : k + 1], radius)[1] for k in range(4)])
    assert sorted(found.tolist()) == near.tolist() and not trees.live[near].any()
    assert trees.below[trees.roots].sum() == trees.live.sum() == len(values) - len(near)
    left, right, _ = simhash.forest(values, shard, radius)
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    assert close[left, right].all() and (shard[left] == shard[right]).all()
    pairs = np.argwhere(close & (shard[:, None] == shard[None, :]))
    want, own = spanned(len(values), *pairs.T.tolist()), spanned(len(values), left.tolist(), right.tolist())
    assert same_parts(want, own) and len(left) == len(values) - len(set(want))  # a forest, however dense


def test_trees_on_a_table(spark):
    """On a table's fingerprints the shards are trees with inner nodes, and the search leaves most edges out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = np.array(sorted({simhash.fingerprint(r["text"]) for r in docs.select("text").collect()}), np.int64).view(np.uint64)
    inner = followed = nodes = asked = 0
    for mask in simhash.shard_masks(len(fps)):
        key = fps & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        values, shard = fps[order], np.unique(key[order], return_inverse=True)[1]
        *_, trees = simhash.forest(values, shard)
        inner += len(np.unique(trees.parent[trees.parent >= 0]))
        sizes = np.bincount(shard)
        nodes, followed, asked = nodes + len(values), followed + trees.followed, asked + int((sizes * sizes).sum())
        assert len(trees.levels) > 2 and sizes.max() < 4 * simhash.PER_SHARD
    assert inner > nodes / 8 and nodes < followed < asked / 2, (inner, nodes, followed, asked)


@pytest.mark.parametrize("n", [0, 1, 900, 10**6, 10**9, 10**12])
def test_every_close_pair_shares_a_shard(n):
    rng, masks = random.Random(n), simhash.shard_masks(n)
    assert len(set(masks)) == len(masks)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), 4))
        assert any(x & m == y & m for m in masks)


def test_one_of_each_group_stays(spark):
    docs = crowded(odd_docs(spark))
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns and out.filter("fp <> 'mine'").count() == 0
    want = sorted({c for _, _, c in got(simhash.grouped(odd_docs(spark)))})
    assert sorted(str(r["doc_id"]) for r in rows_of(out)) == want
    assert simhash.deduplicated(empty_docs(spark)).count() == 0 and simhash.grouped(empty_docs(spark)).count() == 0
