import math
import re
from collections import defaultdict

from tidemark.llm import mixing

from .util import SF, crowded, empty_docs, odd_docs, odd_rows, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict) -> dict:
    """By rounds: share out by weight, fix what is above its cap, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return out | {s: level * weight[s] for s in open_}
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def hold(rows: list[dict], docs: list[tuple]) -> None:
    sizes: dict = defaultdict(int)
    size_of = defaultdict(list)
    for i, text, _, source, _ in docs:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        size_of[i].append((n, source))
    want = brute_targets(dict(sizes))
    assert len(rows) == len(docs)
    taken: dict = defaultdict(int)
    for r in rows:
        options = [s for n, s in size_of[r["doc_id"]] if n == r["size"] and sizes[s] == r["source_size"]]
        assert options
        assert any(math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in options)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    largest = max(n for v in size_of.values() for n, _ in v)
    for s, t in want.items():
        assert abs(taken[round(t, 6), sizes[s]] - t) <= 2 * largest


def test_odd_rows(spark):
    docs = odd_rows()
    hold(rows_of(mixing.mixed(odd_docs(spark))), docs)


def test_table_near_targets_and_repeatable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(mixing.mixed(docs))
    hold(got, [(r["doc_id"], r["text"], None, r["source"], None) for r in docs.collect()])
    again = rows_of(mixing.mixed(docs.repartition(7)))
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = crowded(odd_docs(spark))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.filter("_size = 'mine' and _key = 'mine'").count() == out.count()
    assert out.count() == sum(r["copies"] for r in rows_of(mixing.mixed(odd_docs(spark))))


def test_empty(spark):
    assert mixing.mixed(empty_docs(spark)).count() == 0 and mixing.mix(empty_docs(spark)).count() == 0


def test_without_words(spark):
    docs = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], odd_docs(spark).schema)
    assert [(r["size"], r["target"], r["taken"]) for r in rows_of(mixing.mixed(docs))] == [(0, 0.0, 0)] * 2


def test_blocks_are_even_and_reruns_repeat_the_same_rows(spark):
    """Ids that are multiples of 1,024, null ids and equal ids with other texts: spread over blocks, ranked in full."""
    rows = [(k * 1024 if k % 3 else None, f"text number {k} of many", "en", "a", k) for k in range(600)]
    rows += [(5, f"four words and {k}", "en", "a", k) for k in range(200)] + [(6, "the very same text", "en", "b", k) for k in range(200)]
    docs = spark.createDataFrame(rows, odd_docs(spark).schema)
    from pyspark.sql import functions as F

    marked = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.text_mark(F.col("text")).alias("mark"))
    assert mixing.with_copies(marked, "mark").count() == len(rows)
    first = sorted(map(str, mixing.mix(docs).collect()))
    assert first == sorted(map(str, mixing.mix(docs.orderBy(F.rand(3)).repartition(9)).collect()))
    block = (F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "mark").cast("binary")), 1, 6), 16, 10).cast("int") % mixing.BLOCKS).alias("b")
    assert marked.filter("doc_id is null or doc_id % 1024 = 0").select(block).distinct().count() > 300


def test_table_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.sql(mixing.ORACLE)
    want = sorted(tuple(r) for r in rel.fetchall())
    assert sorted(tuple(r[c] for c in rel.columns) for r in rows_of(mixing.mixed(spark.read.parquet(f"{SF}/documents.parquet")))) == want
