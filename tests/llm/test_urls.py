import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.llm import urls

from .util import SF, empty_labels, rows_of

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.com/en/7"), (5, "http://a.example.com/en/71?x=1"), (6, "http://notexample.com/en/7"),
    (7, "https://x.NET/de/8"), (8, "https://example.net/de/8"), (9, "https://example.net/de/9"), (10, "ftp://org/es/"), (11, "ftp://org/es"), (12, "http://a.org/ES/"),
    (13, "://com/en/"), (14, "http://com?/en/"), (15, "http://com#/en/"), (16, "x://y://com/en/"), (17, "http://b.com/en/\nline"), (18, "http://ÄÖ.COM/en/x"),
    (19, "http://example.com/en/7"), (19, "http://example.com/en/7"), (None, "http://example.com/en/"), (20, "http://com/en"), (21, "http:///en/"), (22, "http://.com/en/"), (23, "a" * 200_000 + "://com/en/" + "b/" * 100_000),
]


def brute(url) -> tuple:
    url = url or ""
    if "://" not in url:
        host = path = ""
    else:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(AZ)
    best = None
    for kind, rule in urls.RULES:
        at = rule.index("/")
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]) and (best is None or len(rule) > len(best[0])):
            best = (rule, kind)
    return host, path, *(best or (None, None))


def hold(rows, pairs):
    rows = sorted(rows, key=lambda r: (str(r["page_id"]), r["host"], r["path"]))
    want = sorted(((str(i), *brute(u)) for i, u in pairs), key=lambda w: w[:3])
    assert [(str(r["page_id"]), r["host"], r["path"], r["rule"]) for r in rows] == [w[:4] for w in want]
    for r, w in zip(rows, want):
        assert r["verdict"] == (w[4] or ("block" if r["mined"] else "allow"))


def test_fixed_rules(spark):
    pages = spark.createDataFrame(ODD, "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(25)], "doc_id long, quality int, toxic int")
    hold(rows_of(urls.judged(pages, labels)), ODD)
    rows = rows_of(urls.judged(pages, empty_labels(spark)))
    assert not any(r["mined"] for r in rows)
    assert urls.judged(pages.limit(0), labels).count() == 0


def test_rules_of_the_contract(spark):
    """The list as the contract words it; a subdomain's longer rule decides against the general one."""
    assert ", ".join(" ".join(r) for r in urls.RULES) == "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    pages = spark.createDataFrame([(1, "http://x.net/de/1"), (2, "http://example.net/de/1"), (3, "http://a.example.net/de/81")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in rows_of(urls.judged(pages, empty_labels(spark)))}
    assert got == {1: ("net/de/", "allow"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block")}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_table(spark, sf):
    pages = spark.read.parquet(f"{SF[:-7]}{sf}/pages.parquet")
    labels = spark.read.parquet(f"{SF[:-7]}{sf}/labels.parquet")
    hold(rows_of(urls.judged(pages, labels)), [(r["page_id"], r["url"]) for r in pages.collect()])


def brute_tokens(url) -> frozenset:
    """The same tokens, read off the URL one part after the other."""
    if "://" not in url:
        return frozenset()
    scheme, _, rest = url.partition("://")
    cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    own, tail = rest[:cut].translate(AZ), rest[cut:]
    before, _, after = tail.partition("#")[0].partition("?")
    words = lambda s: [w for w in re.split(r"[^a-z0-9\u0080-\U0010ffff]+", re.sub("[0-9]+", "0", s).translate(AZ)) if w]
    out = {"h:" + w for w in own.split(".") if w} | {"p:" + w for w in words(before)} | {"q:" + w for w in words(after)}
    return frozenset(out | ({"s:" + scheme.translate(AZ)} if scheme else set()))


def brute_rules(items: dict, bad: set, support: float, confidence: float, lift: float, least: int) -> list[frozenset]:
    """All token sets that pass the thresholds, counted one by one; then those without a proper part among them."""
    counts: dict = {}
    for i, own in items.items():
        for size in range(1, len(own) + 1):
            for c in combinations(sorted(own), size):
                n = counts.setdefault(frozenset(c), [0, 0])
                n[0] += 1
                n[1] += i in bad
    total = len(items)
    found = [c for c, (n, b) in counts.items() if b >= max(support * total, least) and b / n >= confidence and b / n / (len(bad) / total) >= lift]
    return [c for c in found if not any(d < c for d in found)]


def test_mined_rules_against_brute_force(spark):
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        word = ("win", "prize")[k % 8 // 4] if bad else ("news", "blog", "win")[k % 3]
        rows.append((k, f"http://s{k % 5}.Example.org/{word}/{'Casino' if bad and k % 3 else 'page'}?id={k}#x"))
        labels.append((k, 0 if bad else 1, 0))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    items, bad = {i: brute_tokens(u) for i, u in rows}, {i for i, q, _ in labels if q == 0}
    for least in (1, 10, 40):
        want = brute_rules(items, bad, 0.02, 0.8, 1.5, least)
        kw = {"min_support": 0.02, "min_confidence": 0.8, "min_lift": 1.5, "min_pages": least}
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert {frozenset(r[0]) for r in urls.mine(pages, table, **kw).rules} == set(want) and want
        fires = {r["page_id"] for r in rows_of(urls.judged(pages, table, **kw)) if r["mined"]}
        assert fires == {i for i, own in items.items() if any(r <= own for r in want)}


def test_pruning_looks_at_all_proper_parts():
    chain = [frozenset("ab"), frozenset("abc"), frozenset("abcd"), frozenset("cd"), frozenset("x"), frozenset("wxyz")]
    assert {frozenset(r[0]) for r in urls.prune([(c, 0.9, 0.1) for c in chain]).rules} == {frozenset("ab"), frozenset("cd"), frozenset("x")}


def test_rules_hold_on_pages_that_were_not_mined(spark):
    """On a table with real signal the rules of half the labels are right about the other half; on noise there are none."""
    import random

    rng, rows, labels = random.Random(12), [], []
    for k in range(3000):
        bad = rng.random() < 0.25
        word = rng.choice(["casino", "pills", "spins"]) if bad and rng.random() < 0.8 else rng.choice(["news", "blog", "wiki", "shop"])
        rows.append((k, f"https://{rng.choice('abcdef')}{k}.example.{rng.choice(['com', 'net'])}/{word}/{rng.randrange(10**6)}"))
        labels.append((k, int(not bad), 0))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    seen = spark.createDataFrame([r for r in labels if r[0] % 2], "doc_id long, quality int, toxic int")
    hits = [labels[r["page_id"]][1] == 0 for r in rows_of(urls.judged(pages, seen)) if r["mined"] and r["page_id"] % 2 == 0]
    assert sum(hits) >= 0.95 * len(hits) and len(hits) > 200
    noise = spark.createDataFrame([(k, rng.randrange(2), 0) for k in range(1, 3000, 2)], "doc_id long, quality int, toxic int")
    assert not urls.mine(pages.withColumn("url", F.regexp_replace("url", "casino|pills|spins|news|blog|wiki|shop", "page")), noise).rules


def test_long_rules_are_mined(spark):
    """Only all five words together are blocked; each four of them are fine."""
    words = ["red", "green", "blue", "black", "white"]
    urls_of = ["/".join(words)] * 20 + ["/".join(c) for c in combinations(words, 4)] * 20
    pages = spark.createDataFrame([(k, f"http://example.org/{u}") for k, u in enumerate(urls_of)], "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k >= 20), 0) for k in range(len(urls_of))], "doc_id long, quality int, toxic int")
    assert [set(r[0]) for r in urls.mine(pages, labels).rules] == [{f"p:{w}" for w in words}]
    assert {r["page_id"] for r in rows_of(urls.judged(pages, labels)) if r["mined"]} == set(range(20))


def test_all_minimal_rules_are_kept(spark):
    names = ["".join(chr(97 + k // 26**i % 26) for i in range(3)) for k in range(1100)]
    every = [*names, *names, *["fine"] * 3300]
    pages = spark.createDataFrame([(k, f"http://example.org/x{w}") for k, w in enumerate(every)], "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k >= 2200), 0) for k in range(len(every))], "doc_id long, quality int, toxic int")
    mined = urls.mine(pages, labels, min_support=0.0003, min_pages=2)
    assert {r[0] for r in mined.rules} == {(f"p:x{w}",) for w in names}
    assert {r["page_id"] for r in rows_of(urls.judged(pages, labels, min_support=0.0003, min_pages=2)) if r["mined"]} == set(range(2200))


def test_clashing_columns(spark):
    pages = spark.createDataFrame(ODD, "page_id long, url string")
    for name in ("host", "path", "rule", "verdict", "mined", "_tokens", "items", "bad", "doc_id"):
        pages = pages.withColumn(name, F.lit("mine"))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(25)], "doc_id long, quality int, toxic int").withColumn("page_id", F.lit("mine")).withColumn("url", F.lit("mine"))
    hold(rows_of(urls.judged(pages, labels)), ODD)
