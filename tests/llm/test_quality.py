from zlib import crc32

import numpy as np

from tidemark.llm import quality

from .util import crowded, empty_docs, empty_labels, odd_docs, odd_labels, odd_rows, rows_of

SF = "/root/testdata/sf0.1"


def auc(score, label) -> float:
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = np.array(label) == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = rows_of(quality.judged(docs, labels))
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert auc([r["score"] for r in held], [truth[r["doc_id"]] for r in held]) > 0.9
    good = [r["predicted"] for r in held if truth[r["doc_id"]] == 1]
    assert sum(good) > 0.97 * len(good)


def test_identity_of_the_sum_of_squares():
    rng = np.random.default_rng(0)
    model = quality.Model(bias=0.3, w=rng.normal(size=quality.DIM).astype(np.float32), v=rng.normal(size=(quality.DIM, quality.FACTORS)).astype(np.float32))
    rows = [quality.describe(t, n) for t, n in (("some words here and there, some twice", None), ("", 0), (None, None), ("UPPER 123 ### !!!\nline\nline", 40))]
    ids, x, starts = model.features(rows)
    got, _ = model.raw(ids, x, starts)
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
        i, y = ids[a:b], x[a:b].astype(float)
        pairs = sum(float(model.v[i[p]] @ model.v[i[q]]) * y[p] * y[q] for p in range(len(i)) for q in range(p))
        assert abs(got[k] - (0.3 + float(model.w[i] @ y) + pairs)) < 1e-2


def test_inputs(spark):
    docs, labels = odd_docs(spark), odd_labels(spark)
    rows = rows_of(quality.judged(docs, labels))
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    # Labels of held-out rows, language, source and id change nothing.
    from pyspark.sql import functions as F

    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = rows_of(quality.judged(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), other))
    key = lambda r: (str(r["doc_id"]), r["score"])
    assert sorted(map(key, rows)) == sorted(map(key, changed))
    assert {r["score"] for r in rows_of(quality.judged(docs, empty_labels(spark)))} == {0.5}
    assert quality.judged(empty_docs(spark), labels).count() == 0
    model = quality.train(docs, labels)
    out = quality.with_scores(crowded(docs), model, "_q")
    assert out.columns == [*crowded(docs).columns, "_q"] and out.filter("score <> 'mine'").count() == 0


def test_scores_of_the_query_by_pairs(spark):
    """Scores of a whole table against the sum over all pairs of features, with the model that the same rows train."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in rows_of(quality.judged(docs, labels))}
    for r in docs.collect()[:60]:
        ids, x, _ = model.features([quality.describe(r["text"], r["n_chars"])])
        vx = model.v[ids].astype(float) * x[:, None]
        gram = vx @ vx.T
        z = model.bias + float(model.w[ids].astype(float) @ x) + (gram.sum() - np.trace(gram)) / 2
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-4


def test_repeated_ids_stay_within_the_limit(spark):
    docs = spark.createDataFrame([(k % 4 + 1, f"text {k} of many", "en", "a", k) for k in range(300)], odd_docs(spark).schema)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)] * 3, "doc_id long, quality int, toxic int")
    rows, y = quality.labelled_rows(docs, labels, max_rows=50)
    assert len(rows) == len(y) == 50
