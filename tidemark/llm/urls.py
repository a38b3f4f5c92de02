"""URL filters: fixed host and path rules, and association rules mined by FP-growth. DataFrame functions only.

Fixed rules decide first: a rule fits its host and all subdomains if the path starts with the rule's;
the longest fitting one wins. All other URLs are judged by association rules: the tokens of labelled
URLs (labels of the page's id: blocked if of low quality or toxic), with the label as one more item,
go through FP-growth; rules that conclude "blocked" stay if their support (a share of the labelled pages, and at
least `min_pages` blocked ones), confidence and lift suffice and no proper part of them is such a rule. Labels
name pages by convention: a label's doc_id is read as a page_id. Matching goes through an inverted index from a rule's first token to
the rules; a URL only meets rules under tokens that it has.

At most `max_rows` labelled pages are mined (least hash of the id). All minimal rules that pass the
thresholds are kept, of any length: rules are asked for by length, without those that hold a shorter rule,
so that only minimal ones reach the driver. Their number is bounded by the mined pages, not by the input,
so they are sent along as a literal. The judged pages are not shuffled.

Defined cases: null URLs, and those without `://`, have empty host and path and get the method's verdict
for no tokens, allow; no labels or no surviving rules: allow; equal URLs get equal verdicts.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
MAX_ROWS = 50_000
MIN_PAGES = 10
LABEL = "=blocked"
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), *_AZ), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fixed_rule(h: Column, p: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last one asked is the longest
        at = text.index("/")
        own, start = text[:at], text[at:]
        fits = ((h == own) | F.endswith(h, F.lit("." + own))) & F.startswith(p, F.lit(start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: labels of the host, words of path and query (digits as one sign), each with its place."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    words = lambda x: F.filter(F.split(F.translate(F.regexp_replace(x, "[0-9]+", "0"), *_AZ), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda w: w != "")
    hosts = F.filter(F.split(host(url), r"\."), lambda w: w != "")
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), *_AZ)
    every = F.concat(
        F.transform(hosts, lambda w: F.concat(F.lit("h:"), w)),
        F.transform(words(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)), lambda w: F.concat(F.lit("p:"), w)),
        F.transform(words(F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)), lambda w: F.concat(F.lit("q:"), w)),
        F.filter(F.array(F.concat(F.lit("s:"), scheme)), lambda w: w != "s:"),
    )
    return F.when(F.instr(url, "://") > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Mined:
    rules: tuple[tuple[tuple[str, ...], float, float], ...] = ()  # tokens, confidence, support


def prune(found: list[tuple[frozenset, float, float]]) -> Mined:
    """Rules of which no proper part, of any length, is a rule already; best confidence first."""
    kept: list[tuple[frozenset, float, float]] = []
    index: dict[str, list[frozenset]] = {}  # a token of each kept rule -> those rules
    for items, confidence, support in sorted(found, key=lambda r: (len(r[0]), sorted(r[0]))):
        if not any(part <= items for token in items for part in index.get(token, ())):
            kept.append((items, confidence, support))
            index.setdefault(min(items), []).append(items)
    kept.sort(key=lambda r: (-r[1], -r[2], sorted(r[0])))
    return Mined(tuple((tuple(sorted(i)), c, s) for i, c, s in kept))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6, min_lift: float = 1.5, min_pages: int = MIN_PAGES, max_rows: int = MAX_ROWS) -> Mined:
    bad = (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("page_id"))
        .agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad"))
        .filter(F.col("bad").isNotNull())
    )
    few = (
        pages.filter(F.instr("url", "://") > 0)
        .select(F.col("page_id").cast("long").alias("page_id"), "url")
        .join(bad, "page_id")
        .orderBy(F.xxhash64("page_id"), "page_id", "url")
        .limit(max_rows)
        .select(F.concat(tokens(F.col("url")), F.when(F.col("bad") == 1, F.array(F.lit(LABEL))).otherwise(F.array().cast("array<string>"))).alias("items"))
    )
    few = few.persist()
    pages_mined = few.count()  # also bounds what is kept
    if not pages_mined:
        return Mined()
    rules = (
        FPGrowth(itemsCol="items", minSupport=max(min_support, min(min_pages / pages_mined, 1.0)), minConfidence=min_confidence)
        .fit(few)
        .associationRules.filter((F.col("consequent") == F.array(F.lit(LABEL))) & (F.col("lift") >= min_lift))
        .select("antecedent", "confidence", "support")
        .persist()
    )
    found: list[tuple[frozenset, float, float]] = []
    for row in rules.select(F.size("antecedent").alias("n")).distinct().orderBy("n").collect():  # one row a length
        minimal = rules.filter((F.size("antecedent") == row["n"]) & ~matches(F.col("antecedent"), prune(found)))
        found += [(frozenset(r["antecedent"]), r["confidence"], r["support"]) for r in minimal.collect()]
    rules.unpersist()
    few.unpersist()
    return prune(found)


def matches(own: Column, mined: Mined) -> Column:
    """Whether the tokens hold all tokens of some rule: rules are looked up by their first token."""
    index: dict[str, list[tuple[str, ...]]] = {}
    for items, _, _ in mined.rules:
        index.setdefault(items[0], []).append(items)
    if not index:
        return F.lit(False)
    lookup = F.from_json(F.lit(json.dumps(index, sort_keys=True)), "map<string, array<array<string>>>")  # one literal, however many rules
    keys = F.map_keys(lookup)
    return F.exists(F.array_intersect(own, keys), lambda t: F.exists(F.element_at(lookup, t), lambda r: F.size(F.array_except(r, own)) == 0))


def judged(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, **kw) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; `mined` tells whether an association rule fired."""
    mined = mine(pages, labels, **kw)
    url = F.col("url").cast("string")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return (
        pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("_tokens"))
        .withColumn("mined", F.coalesce(matches(F.col("_tokens"), mined), F.lit(False)))
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mined")
    )
