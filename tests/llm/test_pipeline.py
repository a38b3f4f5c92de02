import hashlib
import math
import re
from collections import defaultdict

import pytest

import corpus_pipeline as cp
from tidemark.llm import pieces, quality
from tidemark.llm.registry import piece_model

from .test_mixing import brute_targets
from .test_simhash import brute_groups, brute_print
from .util import SF, crowded, empty_docs, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns over the smallest tables, written and read again."""
    at, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out["documents"] = docs
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{at}/{name}")
        docs = out[name] = spark.read.parquet(f"{at}/{name}")
    return out


def test_columns(kept):
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "near_duplicates", "repeats", "mixture", "pieces"]
    assert all(kept[n].columns == kept["documents"].columns for n in names[:-1])
    assert all(kept[n].count() for n in names)


def test_quality_rejects_what_the_model_rejects(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdicts = {r["doc_id"]: r["predicted"] for r in rows_of(quality.judged(kept["documents"], labels))}
    assert sorted(r["doc_id"] for r in kept["quality"].collect()) == sorted(i for i, p in verdicts.items() if p)


def test_one_of_each_near_duplicate_group(kept):
    pairs = [(r["doc_id"], r["text"]) for r in kept["quality"].collect()]
    groups = brute_groups([(i, brute_print(t)) for i, t in pairs])
    assert sorted(str(r["doc_id"]) for r in kept["near_duplicates"].collect()) == sorted({c for _, _, c in groups})


def test_repeats_go(kept):
    before = {r["doc_id"]: r["text"] for r in kept["near_duplicates"].collect()}
    after = {r["doc_id"]: r["text"] for r in kept["repeats"].collect()}
    assert before.keys() == after.keys()
    least: dict = {}
    for i in sorted(before):
        raw = (before[i] or "").encode()
        for k in range(len(raw) - 49):
            least.setdefault(raw[k : k + 50], i)
    for i, text in before.items():
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if least[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        want = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        assert (after[i] or "") == want


def test_mixture(kept):
    rows = kept["repeats"].collect()
    sizes: dict = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want, taken = brute_targets(dict(sizes)), defaultdict(int)
    for r in kept["mixture"].collect():
        taken[r["source"]] += len(WORD.findall(r["text"] or ""))
    largest = max(len(WORD.findall(r["text"] or "")) for r in rows)
    assert all(abs(taken[s] - t) <= 2 * largest for s, t in want.items())


def test_pieces(kept):
    table = pieces.prefix_table(piece_model())
    texts = {r["doc_id"]: r["text"] for r in kept["mixture"].collect()}
    assert kept["pieces"].count() == kept["mixture"].count()
    for r in rows_of(kept["pieces"]):
        assert r["ids"] == table.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["decoded"] == table.decode(r["ids"])


def test_empty_and_crowded_tables(spark):
    for name, stage in cp.STAGES:
        assert stage(spark, empty_docs(spark), SF).count() == 0, name
    docs = crowded(spark.read.parquet(f"{SF}/documents.parquet").limit(30))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.filter("size <> 'mine' or w <> 'mine'").count() == 0, name


def test_run_equals_the_stages(spark, kept):
    digest = lambda df: sorted((r["doc_id"], hashlib.sha256(str(r["ids"]).encode()).hexdigest()) for r in df.collect())
    assert digest(cp.run(spark, SF)) == digest(kept["pieces"])
    assert not math.isnan(kept["pieces"].count())
