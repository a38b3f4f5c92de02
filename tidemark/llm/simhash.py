"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, connected components.

Fingerprint of a text (A-Z lower-cased): each of 64 bits is 1 if it is set in over half of the XXH64
(seed 42) of its 4-word shingles, repeats included; fewer words make one shingle, none makes zero.
Fingerprints link at RADIUS or fewer differing bits; linked ones, directly or not, form a component.

Exact search: the 64 bits are cut into blocks. Two linked fingerprints agree in at least blocks - RADIUS
of them, so they meet in the shard of some choice of that many blocks. A shard holds distinct
fingerprints only, so copies cost nothing; the number of key bits grows with the number of distinct
fingerprints, so that a shard holds about PER_SHARD. In a shard every fingerprint is a node of a BK-tree
(children keyed by the integer distance to the parent), which is searched along the edges within the
radius; found nodes leave the tree and are searched from next, so a dense shard yields a spanning forest,
not all its pairs. A shard with over MOST fingerprints is cut into parts and each pair of parts solved
apart. Shards are dealt out by their key instead of broadcast: a broadcast would bring the fingerprints
of all documents to the driver, and they have no size bound. The links do not depend on the shards.

Defined cases: null text is an empty text (fingerprint zero, which links like any other); a null id never
is a component's id, unless all ids of the component are null; repeated rows all get their component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import boxed, checkpointed, mapped, plus, shuffle_width, tokens_lower
from .components import components

RADIUS = 4
SHINGLE = 4
PER_SHARD, MOST = 64, 10_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64 bits as a signed integer, as Spark's long has them."""
    words = tokens_lower(text)
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) < width:
        starts, ends = [0], [len(whole)]
    else:
        last = np.cumsum([len(w) + 1 for w in words]) - 1
        ends = last[width - 1 :].tolist()
        starts = [0, *(last[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, 1 << 16):
        h = np.array([digest(whole[a:b], 42) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)], strict=True)], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


class BKTrees:
    """One BK-tree for each run of equal shard numbers: every value is a node, its children keyed by their distance to it.

    All trees grow and are searched side by side, level by level. Nodes are the positions of the values; `key`
    lists the edges in order (65 * parent + distance) and `child` where they lead.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        n = len(values)
        self.values = values.view(np.uint64)
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        self.levels: list[np.ndarray] = []
        rest, group, lead, edge = np.arange(n), shard, np.full(n, -1), np.zeros(n, np.int64)
        while len(rest):
            fresh = np.append(True, group[1:] != group[:-1])
            node = rest[fresh]
            self.parent[node], self.edge[node] = lead[fresh], edge[fresh]
            self.levels.append(node)
            lead, rest = node[np.cumsum(fresh) - 1][~fresh], rest[~fresh]
            edge = np.bitwise_count(self.values[rest] ^ self.values[lead]).astype(np.int64)
            group = lead * 65 + edge
            order = np.argsort(group, kind="stable")
            rest, lead, edge, group = rest[order], lead[order], edge[order], group[order]
        if (self.edge[self.parent >= 0] == 0).any():
            raise ValueError("values must be distinct")
        self.roots = self.levels[0] if n else np.zeros(0, np.int64)
        self.child = np.flatnonzero(self.parent >= 0)
        self.key = self.parent[self.child] * 65 + self.edge[self.child]
        order = np.argsort(self.key)
        self.child, self.key = self.child[order], self.key[order]
        self.live = np.ones(n, bool)
        self.below = np.ones(n, np.int64)  # live nodes of the subtree
        for level in self.levels[:0:-1]:
            np.add.at(self.below, self.parent[level], self.below[level])
        self.followed = 0

    def take(self, query: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """For queries (values) each from its node down, (number of the query, node) of the live nodes within the radius.

        An edge is followed if its distance is within the radius of the query's distance to the parent. No two
        queries may search one tree at a time: what is found leaves the tree.
        """
        which, hits = np.arange(len(query)), []
        while len(node):
            d = np.bitwise_count(self.values[node] ^ query[which]).astype(np.int64)
            near = self.live[node] & (d <= radius)
            if near.any():
                hits.append((which[near], node[near]))
            at = node * 65
            low = np.searchsorted(self.key, at + np.maximum(d - radius, 0))
            size = np.searchsorted(self.key, at + np.minimum(d + radius, 64), "right") - low
            ends = np.cumsum(size)
            to = self.child[np.repeat(low - ends + size, size) + np.arange(ends[-1])]
            open_ = self.below[to] > 0
            which, node = np.repeat(which, size)[open_], to[open_]
            self.followed += len(node)
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.concatenate([h[1] for h in hits])
        self.remove(found)
        return np.concatenate([h[0] for h in hits]), found

    def remove(self, nodes: np.ndarray) -> None:
        self.live[nodes] = False
        while len(nodes):
            np.subtract.at(self.below, nodes, 1)
            nodes = self.parent[nodes]
            nodes = nodes[nodes >= 0]


def forest(values: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, BKTrees]:
    """Links (positions) that span the components of each shard's distinct values; equal shards stand together.

    Each round, every shard that has live nodes asks once: the oldest found value that has not asked yet, or
    else the next live one, which leaves the tree itself. Found values leave the tree and ask later.
    """
    trees, n = BKTrees(values, shard), len(values)
    start = trees.roots  # the first of each shard
    seed, head, tail = start.copy(), start.copy(), start.copy()
    queue = np.zeros(n, np.int64)  # each shard's part of it holds what was found
    left, right = [], []
    active = np.arange(len(start))
    while len(active := active[trees.below[start[active]] > 0]):
        asks = head[active] == tail[active]
        new = active[asks]
        while len(late := new[~trees.live[seed[new]]]):
            seed[late] += 1
        trees.remove(seed[new])
        at = np.where(asks, seed[active], queue[np.minimum(head[active], n - 1)])
        head[active[~asks]] += 1
        which, found = trees.take(trees.values[at], start[active], radius)
        if len(found):
            left.append(at[which])
            right.append(found)
            order = np.argsort(which, kind="stable")
            which, found = which[order], found[order]
            first = np.searchsorted(which, which)
            queue[tail[active[which]] + np.arange(len(which)) - first] = found
            np.add.at(tail, active[which], 1)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none), trees


def shard_masks(n: int, radius: int = RADIUS, per_shard: int = PER_SHARD) -> list[int]:
    """The bits that make the shard keys, so that a shard holds about per_shard of n even fingerprints.

    The 64 bits are cut into more blocks than the radius; two that link agree in all but `radius` blocks. Each
    choice of that many blocks gives one key, of as many bits of its blocks as n asks for.
    """
    bits = max(n // per_shard, 1).bit_length()
    blocks = radius + 1
    while blocks < radius + 4 and bits > 64 // blocks * (blocks - radius):
        blocks += 1
    share = min(-(-bits // (blocks - radius)), 64 // blocks)
    part = [((1 << share) - 1) << 64 * k // blocks for k in range(blocks)]
    return [sum(c) for c in combinations(part, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that connect what the radius connects."""
    masks = [_signed(m) for m in shard_masks(distinct.count(), radius)]
    keyed = distinct.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "key"), "fp")
    # A shard over `most` is cut into parts; each pair of parts is a shard of its own, so every pair of values still meets.
    hot = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("choice", "key", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(own, k) * F.col("parts") + F.greatest(own, k))
    cut = keyed.join(hot, ["choice", "key"], "left").select("choice", "key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(others)).alias("part"), "fp")
    dealt = cut.repartition(shuffle_width(distinct.sparkSession), "choice", "key", "part").sortWithinPartitions("choice", "key", "part", "fp")

    def solve(waiting: list[np.ndarray], whole: bool) -> tuple[Iterator[pa.RecordBatch], np.ndarray]:
        """Links of the shards that are complete, and the rows of the last one, which may go on."""
        rows = np.concatenate(waiting)
        new = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))
        cut = len(rows) if whole else int(np.flatnonzero(new)[-1])
        a, b, _ = forest(rows[:cut, 3].copy(), np.cumsum(new[:cut]), radius)
        made = [pa.RecordBatch.from_arrays([pa.array(rows[a, 3]), pa.array(rows[b, 3])], names=["u", "v"])] if len(a) else []
        return iter(made), rows[cut:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1))
            size += batch.num_rows
            if size >= 200_000:
                made, rest = solve(waiting, False)
                yield from made
                waiting, size = [rest], len(rest)
        if size:
            yield from solve(waiting, True)[0]

    return mapped(dealt, run, "u long, v long")


def with_fingerprints(df: DataFrame, text_col: str = "text", fp_col: str = "fp", width: int = SHINGLE) -> DataFrame:
    df = df.drop(fp_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t.as_py(), width) for t in batch.column(text_col)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, fp_col])

    return mapped(df, run, plus(df, **{fp_col: "long"}))


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component_id (the component's least id), and with a column `mark` the least mark of that id, of each distinct fingerprint of (doc_id, fp)."""
    marked = "mark" in prints.columns
    id_, mark = F.col("doc_id"), F.col("mark") if marked else F.lit(None).cast("string")
    first = F.min(F.struct(id_.isNull().alias("none"), id_.alias("id"), mark.alias("mark"))) if marked else F.struct(F.min(id_).isNull().alias("none"), F.min(id_).alias("id"), F.first(mark).alias("mark"))
    least = checkpointed(prints.groupBy("fp").agg(first.alias("first")))
    roots = components(links(least.select("fp"), radius)).withColumnsRenamed({"node": "fp"})
    rooted = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(ids, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.mark").alias("mark"))


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    thin = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    prints = checkpointed(with_fingerprints(thin).select("doc_id", "fp"))
    return prints.join(classes(prints).drop("mark"), "fp").select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with the least id (then least hash of the text, then of the row).

    Columns as before, whatever their names. Whole rows are shuffled once, by id and hash of the text.
    """
    text = F.col("text").cast("string")
    mark = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), text.alias("text"))
    prints = checkpointed(with_fingerprints(thin).select("doc_id", "mark", "fp"))
    key = lambda i, m: F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("")), m).alias("key")
    keep = classes(prints).select(key(F.col("component_id"), F.col("mark"))).distinct()
    rows = docs.select(boxed(docs), key(F.col("doc_id").cast("long"), mark)).join(keep, "key", "left_semi")
    order = F.xxhash64(*[F.col("row").getField(c) for c, t in docs.dtypes if "map<" not in t])
    return rows.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(order))).filter("n = 1").select("row.*")
