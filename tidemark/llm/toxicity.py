"""Toxicity: a classifier chain over categories mined from the labels.

Features of a text: its distinct words (runs of letters, lower-cased) and their prefixes of four and
five letters, hashed. The labelled sample picks those that tell toxic from clean texts; of these, the
ones that speak for toxicity are grouped by how often they stand in the same toxic texts, and each
group is a category (the tables name none): a text carries it if it is labelled toxic and holds one of
its features. The chain predicts the categories one after the other and toxicity last. Each link is a
logistic model of the features and of the probabilities of the links before it; in training those are
out-of-fold predictions, so that a link learns from what it will see. A fold's predictions come from a
model that has seen none of its labels: features and categories are chosen anew from the other folds, and
each category is paired with the one most like it there. Equal texts are in one fold.

The sample has at most `max_rows` labelled rows (least hash of the id, then of label and features, should ids
repeat) and the model at most FEATURES weights a link, whatever the input's size. All rows are scored in one
pass without a shuffle.

Defined cases: null or empty text has no feature and gets the base rate; null labels teach nothing;
without labels the score is 0 and nothing is toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 12000
FEATURES = 2048
CATEGORIES = 4
FOLDS = 4
LEAST = 4
SPACE = 1 << 22
_LETTERS = re.compile(r"[^\W\d_]+")


def hashed(text: str | None) -> set[int]:
    out = set()
    for w in set(_LETTERS.findall((text or "").lower())):
        b = w.encode()
        out.add(crc32(b) & (SPACE - 1))
        if len(w) > 4:
            out.add(crc32(w[:4].encode(), 4) & (SPACE - 1))
            if len(w) > 5:
                out.add(crc32(w[:5].encode(), 5) & (SPACE - 1))
    return out


@dataclass
class Chain:
    selected: dict[int, int] = field(default_factory=dict)
    links: list[np.ndarray] = field(default_factory=list)  # weights: features, earlier links, bias
    threshold: float = 0.5

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Texts x links: probabilities, toxicity last."""
        if not self.links:
            return np.zeros((len(texts), 1))
        get = self.selected.get
        out = np.zeros((len(texts), len(self.links)))
        for k, text in enumerate(texts):
            here = np.array(sorted(j for f in hashed(text) if (j := get(f)) is not None), np.int64)
            for n, w in enumerate(self.links):
                z = w[here].sum() + out[k, :n] @ w[FEATURES : FEATURES + n] + w[-1]
                out[k, n] = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return out


def _logistic(rows: np.ndarray, cols: np.ndarray, n: int, dense: np.ndarray, y: np.ndarray, steps: int = 120, l2: float = 2e-4) -> np.ndarray:
    """Weights of a logistic model of sparse 0/1 features (pairs row, column) and dense ones. Adam, full batch."""
    size = FEATURES + CATEGORIES + 1
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    d = dense.shape[1]
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols], n) + dense @ w[FEATURES : FEATURES + d] + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / n
        g = l2 * w
        g[:FEATURES] += np.bincount(cols, e[rows], FEATURES)
        g[FEATURES : FEATURES + d] += dense.T @ e
        g[-1] = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _apply(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
    z = np.bincount(rows, w[cols], n) + dense @ w[FEATURES : FEATURES + dense.shape[1]] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _categories(selected: list[int], lift: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray) -> list[set[int]]:
    """Groups of features (positions in selected) that meet in the same toxic texts, greedily from the strongest."""
    toxic = {int(r): k for k, r in enumerate(np.flatnonzero(y))}
    strong = [j for j in range(len(selected)) if lift[j] > np.log(8)]
    held = np.zeros((len(selected), max(len(toxic), 1)), np.float32)
    for r, c in zip(rows, cols, strict=True):
        if (k := toxic.get(int(r))) is not None:
            held[c, k] = 1
    groups: list[tuple[np.ndarray, set[int]]] = []
    for j in strong:
        x = held[j]
        near = [float(x @ g) / (np.sqrt(float(x @ x) * float(g @ g)) + 1e-9) for g, _ in groups]
        if near and (max(near) > 0.2 or len(groups) >= CATEGORIES):
            k = int(np.argmax(near))
            groups[k] = (np.maximum(groups[k][0], x) if near[k] > 0.2 else groups[k][0], groups[k][1] | {j})
        else:
            groups.append((x.copy(), {j}))
    return [g for _, g in groups]


@dataclass
class Sample:
    """Labelled rows as pairs (row, feature): features are numbered, `used` has their hashes. Those of under LEAST rows are left out."""

    rows: np.ndarray
    cols: np.ndarray
    used: np.ndarray
    fold: np.ndarray

    @classmethod
    def of(cls, features: list[np.ndarray]) -> Sample:
        flat = np.concatenate([*features, np.zeros(0, np.uint32)]).astype(np.uint32)
        used = np.flatnonzero(np.bincount(flat, minlength=SPACE) >= LEAST)
        number = np.full(SPACE, -1, np.int32)
        number[used] = np.arange(len(used))
        cols = number[flat]
        rows = np.repeat(np.arange(len(features), dtype=np.int32), [len(f) for f in features])[cols >= 0]
        fold = np.array([crc32(np.asarray(f, np.uint32).tobytes()) % FOLDS for f in features], np.int64)
        return cls(rows, cols[cols >= 0], used, fold)

    def without(self, k: int) -> Sample:
        """The rows of the other folds, numbered anew."""
        inside = self.fold != k
        at = inside[self.rows]
        number = (np.cumsum(inside) - 1).astype(np.int32)
        return Sample(number[self.rows[at]], self.cols[at], self.used, self.fold[inside])

    def pairs(self, selected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place among the selected features) of the pairs that have one."""
        place = np.full(len(self.used), -1, np.int64)
        place[selected] = np.arange(len(selected))
        at = place[self.cols]
        return self.rows[at >= 0].astype(np.int64), at[at >= 0]

    def target(self, group: set[int], y: np.ndarray) -> np.ndarray:
        """Which rows carry a category: toxic ones that hold one of its features."""
        mine = np.zeros(len(self.used), bool)
        mine[list(group)] = True
        here = np.zeros(len(y))
        here[self.rows[mine[self.cols]]] = 1
        return here * y


@dataclass
class Choice:
    """What a set of labelled rows chooses: features, strongest first, and categories, as sets of them."""

    selected: np.ndarray
    groups: list[set[int]]


def choose(sample: Sample, y: np.ndarray) -> Choice:
    n, pos, size = len(y), float(y.sum()), len(sample.used)
    if not 0 < pos < n:
        return Choice(np.zeros(0, np.int64), [])
    both = np.bincount(sample.cols, minlength=size)
    a = np.bincount(sample.cols[(y > 0)[sample.rows]], minlength=size)
    gain = np.abs(a - both * pos / n) / np.sqrt(both * pos / n + 0.5)
    gain[both < LEAST] = 0
    selected = np.argsort(-gain, kind="stable")[:FEATURES]
    selected = selected[gain[selected] > 2]
    lift = np.log(((a + 0.1) / (pos + 0.2)) / ((both - a + 0.1) / (n - pos + 0.2)))[selected]
    groups = _categories(list(selected), lift, *sample.pairs(selected), y)
    return Choice(selected, [{int(selected[j]) for j in g} for g in groups[:CATEGORIES]])


def _likest(group: set[int], choice: Choice) -> set[int]:
    """The category of another choice that has most in common with a group; its own features, if none has any."""
    best = max(choice.groups, key=lambda g: len(g & group) / len(g | group), default=set())
    return best if best & group else group & {int(f) for f in choice.selected}


def out_of_fold(sample: Sample, y: np.ndarray, groups: list[set[int]]) -> np.ndarray:
    """Rows x links: the probability of each category, and of toxicity, by models that saw no label of the row's fold."""
    n, out = len(y), np.zeros((len(y), len(groups) + 1))
    for k in range(FOLDS):
        inside = sample.fold != k
        if not inside.any() or inside.all():
            continue
        others, own = sample.without(k), y[inside]
        choice = choose(others, own)
        learnt, every = others.pairs(choice.selected), sample.pairs(choice.selected)
        dense, seen = np.zeros((len(own), 0)), np.zeros((n, 0))
        for j, target in enumerate([*(others.target(_likest(g, choice), own) for g in groups), own]):
            w = _logistic(*learnt, len(own), dense, target)
            p = _apply(w, *every, n, seen)
            out[~inside, j] = p[~inside]
            seen = np.column_stack([seen, p])
            dense = seen[inside]
    return out


def fit(features: list[np.ndarray], labels: np.ndarray) -> Chain:
    """The chain from hashed features and 0/1 labels; the same rows in the same order give the same chain."""
    n, y = len(features), labels.astype(float)
    if not n or not 0 < y.sum() < n:
        return Chain()
    sample = Sample.of(features)
    choice = choose(sample, y)
    dense = out_of_fold(sample, y, choice.groups)
    pairs, targets = sample.pairs(choice.selected), [*(sample.target(g, y) for g in choice.groups), y]
    links = [_logistic(*pairs, n, dense[:, :j], t) for j, t in enumerate(targets)]
    last = dense[:, -1]
    grid = np.unique(np.round(np.quantile(last, np.linspace(0.5, 1, 400)), 6))
    f1 = [2 * (y * (last >= t)).sum() / max((last >= t).sum() + y.sum(), 1) for t in grid]
    best = grid[[k for k, f in enumerate(f1) if f >= max(f1) - 1e-9]]
    # In the middle of the equally good ones, and never in reach of the base rate of texts without features.
    return Chain({int(s): k for k, s in enumerate(sample.used[choice.selected])}, links, float(np.clip((best.min() + best.max()) / 2, 0.35, 0.9)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Chain:
    chosen = (
        labels.selectExpr("cast(doc_id as long) as doc_id", "cast(toxic as int) as toxic")
        .filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(max_rows)
    )
    few = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").join(F.broadcast(chosen), "doc_id")  # bounded by the limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.array(sorted(hashed(t)), np.uint32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(made, pa.binary())], names=["doc_id", "toxic", "f"])

    # An id may repeat in either table, so the joined rows are limited as well.
    first = few.mapInArrow(run, "doc_id long, toxic int, f binary").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "f").limit(max_rows)
    rows = first.toArrow()
    ids, toxic, f = (rows.column(k).to_pylist() for k in range(3))
    del rows
    order = sorted(range(len(ids)), key=lambda i: (ids[i], toxic[i], f[i]))
    return fit([np.frombuffer(f[i], np.uint32) for i in order], np.array([toxic[i] for i in order]))


def judged(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, the probability of each category, score (toxicity), predicted (0/1) and toxic (boolean) of every document."""
    chain = train(docs, labels, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most FEATURES weights a link

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            p = model.score(batch.column(1).to_pylist())
            flag = p[:, -1] >= model.threshold
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p[:, :-1].tolist(), pa.list_(pa.float64())), pa.array(p[:, -1], pa.float64()), pa.array(flag.astype(np.int32), pa.int32()), pa.array(flag, pa.bool_())],
                names=["doc_id", "categories", "score", "predicted", "toxic"],
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, categories array<double>, score double, predicted int, toxic boolean")
