"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its hashed words (log counts, scaled to length one), a one-hot bin of each
structure statistic of the text, and of the metadata `n_chars`. Score: the logistic of
w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2], which takes time linear in
the number of features. Labels, language, source and id are never inputs.

The model is fitted on the driver from at most `max_rows` labelled rows (those with the least hash of
their id), so its cost has a bound; every row of the table is scored, in one pass without a shuffle.

Defined cases: null or empty text has no words and is scored by its statistics; a null `n_chars` counts
as the text's own length; null labels or ids teach nothing; without any labels each score is 1/2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, plus

BITS = 16
FACTORS = 6
BINS = 8
STATS = 12
MAX_ROWS = 8000
THRESHOLD = 0.3
WORDS = 1 << BITS
DIM = WORDS + STATS * BINS

_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_SYMBOL, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]=~^_\\@")] = True
_PUNCT[list(b".,;:!?")] = True


def describe(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed words, their values, and the statistics of one text."""
    raw = (text or "").encode()
    words = raw.lower().split()
    n, size = len(words), max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ids, times = np.unique(np.array([crc32(w) & (WORDS - 1) for w in words], np.int64), return_counts=True)
    values = 1 + np.log(times)
    values /= max(math.sqrt(float(values @ values)), 1e-9)
    letters = max(int(counts[65:91].sum() + counts[97:123].sum()), 1)
    stats = [
        math.log1p(n),
        len(raw) / max(n, 1),
        int(counts[_SYMBOL].sum()) / size,
        int(counts[33]) / size,
        int(counts[_UPPER].sum()) / letters,
        int(counts[_DIGIT].sum()) / size,
        int(counts[_PUNCT].sum()) / max(n, 1),
        len(set(words)) / max(n, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        len(lines) / max(n, 1),
        (int(times.max()) if n else 0) / max(n, 1),
        math.log1p(max(n_chars if n_chars is not None else len(text or ""), 0)),
    ]
    return ids, values, stats


@dataclass
class Model:
    bias: float = 0.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(DIM, np.float32))
    v: np.ndarray = field(default_factory=lambda: np.zeros((DIM, FACTORS), np.float32))
    edges: np.ndarray = field(default_factory=lambda: np.zeros((STATS, BINS - 1)))

    def features(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat feature ids and values of described rows, and where each row starts."""
        ids, values, starts, at = [], [], [], 0
        base = WORDS + np.arange(STATS) * BINS
        ones = np.full(STATS, 0.5, np.float32)
        for words, x, stats in rows:
            bins = (np.asarray(stats)[:, None] > self.edges).sum(1)
            ids += [words, base + bins]
            values += [x, ones]
            starts.append(at)
            at += len(words) + STATS
        return np.concatenate(ids).astype(np.int64), np.concatenate(values).astype(np.float32), np.array(starts, np.int64)

    def raw(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.w[ids] * x, starts) + 0.5 * (sums * sums - squares).sum(1), sums

    def score(self, rows: list[tuple]) -> np.ndarray:
        z, _ = self.raw(*self.features(rows))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -35, 35)))


def fit(rows: list[tuple], labels: np.ndarray, epochs: int = 6, rate: float = 0.15, decay: float = 2e-5, seed: int = 7) -> Model:
    """AdaGrad on the logistic loss, in small batches; the same rows in the same order give the same model."""
    model = Model()
    if not len(rows):
        return model
    rng = np.random.default_rng(seed)
    stats = np.array([r[2] for r in rows])
    model.edges = np.stack([np.quantile(s, np.arange(1, BINS) / BINS) for s in stats.T])
    model.v = rng.normal(0, 0.05, (DIM, FACTORS)).astype(np.float32)
    model.bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    gw, gv, gb = np.full(DIM, 1e-2, np.float32), np.full((DIM, FACTORS), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 48):
            part = order[k : k + 48]
            ids, x, starts = model.features([rows[i] for i in part])
            z, sums = model.raw(ids, x, starts)
            error = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[part]
            seg = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(ids))))
            ex = error[seg] * x
            used, back = np.unique(ids, return_inverse=True)
            dw = np.bincount(back, ex, len(used)).astype(np.float32) + decay * model.w[used]
            each = ex[:, None] * (sums[seg] - model.v[ids] * x[:, None])
            dv = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32) + decay * model.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            model.w[used] -= rate * dw / np.sqrt(gw[used])
            model.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            db = float(error.sum())
            gb += db * db
            model.bias -= 0.3 * rate * db / math.sqrt(gb)
    return model


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def _texts(df: DataFrame) -> DataFrame:
    n = "cast(n_chars as long)" if "n_chars" in df.columns else "cast(null as long)"
    return df.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text", f"{n} as n_chars")


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[tuple], np.ndarray]:
    """The described rows and labels to learn from: at most max_rows, by the least hash of the id, none held out."""
    chosen = (
        labels.selectExpr("cast(doc_id as long) as doc_id", "cast(quality as int) as quality")
        .filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(max_rows)
    )
    few = _texts(docs).join(F.broadcast(chosen), "doc_id")  # max_rows ids of 12 bytes: the limit bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            made = [describe(t, n) for t, n in zip(cols["text"], cols["n_chars"], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols["quality"], pa.int32()), pa.array([m[0].astype(np.uint16).tobytes() for m in made], pa.binary()), pa.array([m[1].astype(np.float32).tobytes() for m in made], pa.binary()), pa.array([m[2] for m in made], pa.list_(pa.float64()))],
                names=["doc_id", "quality", "ids", "vals", "stats"],
            )

    # An id may repeat in either table, so the joined rows are limited as well, in a total order of what they hold.
    made = few.mapInArrow(run, "doc_id long, quality int, ids binary, vals binary, stats array<double>")
    got = made.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "ids", "vals", "stats").limit(max_rows).toArrow().to_pydict()
    order = sorted(range(len(got["doc_id"])), key=lambda i: (got["doc_id"][i], got["quality"][i], got["ids"][i]))
    rows = [(np.frombuffer(got["ids"][i], np.uint16).astype(np.int64), np.frombuffer(got["vals"][i], np.float32), got["stats"][i]) for i in order]
    return rows, np.array([got["quality"][i] for i in order], np.float32)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    return fit(*labelled_rows(docs, labels, max_rows))


def _scores(fm: Model, batch: pa.RecordBatch) -> np.ndarray:
    """Scores of a batch's rows, some megabytes of text at a time."""
    texts = batch.column("text").to_pylist()
    chars = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else [None] * len(texts)
    out, k = [np.zeros(0)], 0
    while k < len(texts):
        part, size = [], 0
        while k < len(texts) and size < 1_000_000:
            part.append(describe(texts[k], chars[k]))
            size += len(texts[k] or "") + 1000
            k += 1
        out.append(fm.score(part))
    return np.concatenate(out)


def with_scores(df: DataFrame, model: Model, score_col: str = "quality_score") -> DataFrame:
    """df with the score of each row; every other column of df stays."""
    df = df.drop(score_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIM x (FACTORS + 1) floats: 2 MB at any size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_scores(shared.value, batch), pa.float64())], names=[*batch.schema.names, score_col])

    return mapped(df, run, plus(df, **{score_col: "double"}))


def accepted(df: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df whose score reaches the threshold, with df's own columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch) >= threshold, pa.bool_()))

    return mapped(df, run, df.schema)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, max_rows)
    return with_scores(_texts(docs), model, "score").select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
