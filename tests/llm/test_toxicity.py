import numpy as np

from tidemark.llm import toxicity

from .util import crowded, empty_docs, empty_labels, odd_docs, odd_labels, odd_rows, rows_of

SF = "/root/testdata/sf0.1"


def test_finds_toxic_rows_that_it_did_not_see(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen, unseen = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    truth = {r["doc_id"]: r["toxic"] for r in unseen.collect()}
    rows = [r for r in rows_of(toxicity.judged(docs, seen)) if r["doc_id"] in truth]
    toxic = [r["toxic"] for r in rows if truth[r["doc_id"]] == 1]
    clean = [r["toxic"] for r in rows if truth[r["doc_id"]] == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)
    assert all(0 <= p <= 1 for r in rows for p in [r["score"], *r["categories"]])


def test_odd_tables(spark):
    rows = rows_of(toxicity.judged(crowded(odd_docs(spark)), odd_labels(spark)))
    assert len(rows) == len(odd_rows())
    assert {(r["score"], r["predicted"]) for r in rows_of(toxicity.judged(odd_docs(spark), empty_labels(spark)))} == {(0.0, 0)}
    assert toxicity.judged(empty_docs(spark), odd_labels(spark)).count() == 0


def test_later_links_use_earlier_ones():
    """Where only an earlier link's probability tells the classes apart, the later link follows it."""
    rng = np.random.default_rng(2)
    n = 400
    dense = rng.random((n, 1))
    y = (dense[:, 0] > 0.5).astype(float)
    w = toxicity._logistic(np.zeros(0, np.int64), np.zeros(0, np.int64), n, dense, y, steps=400)
    p = toxicity._apply(w, np.zeros(0, np.int64), np.zeros(0, np.int64), n, dense)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.95


def test_batch_scores_equal_training_scores(spark):
    texts = ["plain words only"] * 30 + ["you vile scum " + "plain words"] * 10
    labels = np.array([0] * 30 + [1] * 10)
    chain = toxicity.fit([np.array(sorted(toxicity.hashed(t)), np.uint32) for t in texts], labels)
    p = chain.score(texts)[:, -1]
    assert p[:30].max() < chain.threshold <= p[30:].min()


def labelled(n=240, seed=3):
    """Texts of two toxic kinds and clean ones, with equal texts among them."""
    rng = np.random.default_rng(seed)
    words = [f"word{chr(97 + k)}x" for k in range(20)]
    kinds = [["vile", "scum"], ["moron", "idiot"], ["lovely", "garden"]]
    texts, labels = [], []
    for k in range(n):
        kind = int(rng.choice(3, p=[0.2, 0.2, 0.6]))
        texts.append(" ".join([*rng.choice(words, 5), *rng.choice(kinds[kind], 2)]) if k % 6 or not texts else texts[-1])
        labels.append(int(kind < 2) if k % 6 or not labels else labels[-1])
    return texts, np.array(labels)


def test_out_of_fold_probabilities_saw_no_label_of_their_fold():
    """Other labels in one fold, features and categories included, leave that fold's probabilities as they are."""
    texts, labels = labelled()
    features = [np.array(sorted(toxicity.hashed(t)), np.uint32) for t in texts]
    sample, y = toxicity.Sample.of(features), labels.astype(float)
    fold = sample.fold
    assert len({(t, f) for t, f in zip(texts, fold)}) == len(set(texts)) and len(set(fold)) == toxicity.FOLDS
    groups = toxicity.choose(sample, y).groups
    assert len(groups) >= 2
    before = toxicity.out_of_fold(sample, y, groups)
    for k in range(toxicity.FOLDS):
        other = np.where(fold == k, 1 - y, y)
        assert (toxicity.out_of_fold(sample, other, groups)[fold == k] == before[fold == k]).all()
    assert ((before[:, -1] > 0.5) == (y > 0.5)).mean() > 0.9


def test_chain_by_hand():
    """Scores, link by link, from the definition; later links take the earlier probabilities."""
    texts, labels = labelled()
    chain = toxicity.fit([np.array(sorted(toxicity.hashed(t)), np.uint32) for t in texts], labels)
    assert len(chain.links) >= 3 and any(w[toxicity.FEATURES] != 0 for w in chain.links[1:])
    got = chain.score([*texts, None, ""])
    for text, row in zip([*texts, None, ""], got.tolist()):
        earlier: list = []
        for w in chain.links:
            z = float(w[-1]) + sum(float(w[chain.selected[h]]) for h in toxicity.hashed(text) if h in chain.selected)
            z += sum(float(w[toxicity.FEATURES + j]) * p for j, p in enumerate(earlier))
            earlier.append(1 / (1 + float(np.exp(-z))))
        assert np.allclose(row, earlier, atol=1e-9)


def test_repeated_ids_stay_within_the_limit(spark):
    docs = spark.createDataFrame([(k % 4, f"text {k} scum" if k % 2 else f"text {k}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(4)] * 3, "doc_id long, quality int, toxic int")
    fits, seen = toxicity.fit, []
    toxicity.fit = lambda f, y: seen.append(len(y)) or fits(f, y)
    try:
        toxicity.train(docs, labels, max_rows=50)
    finally:
        toxicity.fit = fits
    assert seen == [50]
