"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Words and neighbouring pairs of words are hashed into BUCKETS. Two multinomials over the buckets, with
add-one smoothing: the raw corpus (all documents) and the trusted target (documents labelled good). A
document's ratio is the mean of log(p_target / p_raw) over its n-grams; it is kept if the base rules
pass and the ratio reaches the threshold. The same text always gets the same verdict.

The raw counts cover every document. The target is fitted on at most `max_trusted` trusted documents
(least hash of the id), whose ids are broadcast under that bound. Both models are BUCKETS numbers.
Counting needs a shuffle of BUCKETS partial sums a task; judging needs none.

Windows of three words that recur are found inside the row: their hashes, with positions packed below,
are sorted as longs, and equal neighbours in the sorted array mark recurring positions.

Defined cases: null or empty text has zero counts and fails the base rule on length; without n-grams the
ratio is 0; without trusted documents both multinomials are the raw one, so each ratio is 0 and kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 10_000
MAX_TRUSTED = 20_000
THRESHOLD = -0.08
MIN_WORDS = 50
_WS = " \t\n\x0b\x0c\r"
_SPLIT = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, _SPLIT), ""), F.array().cast("array<string>"))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _indices(n: Column) -> Column:
    """0 .. n - 1, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def ngram_buckets(h: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the words and of the pairs of words, from the words' hashes."""
    single = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)))
    pairs = F.transform(_indices(F.size(h) - 1), lambda i: F.pmod(F.xxhash64(F.get(h, i), F.get(h, i + 1)), F.lit(buckets)))
    return F.concat(single, pairs)


def counts(docs: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """n-grams of all documents by bucket; the result's size is fixed."""
    h = docs.select(word_hashes(F.col("text").cast("string")).alias("h"))
    rows = h.select(F.explode(ngram_buckets(F.col("h"), buckets)).alias("b")).groupBy("b").count().collect()  # at most `buckets` rows
    out = [0] * buckets
    for b, n in rows:
        out[b] = n
    return out


def log_ratios(target: list[int], raw: list[int]) -> list[float]:
    if not sum(target):
        return [0.0] * len(raw)
    t, r, n = sum(target), sum(raw), len(raw)
    return [math.log((a + 1) / (t + n)) - math.log((b + 1) / (r + n)) for a, b in zip(target, raw, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, max_trusted: int = MAX_TRUSTED, buckets: int = BUCKETS) -> list[float]:
    trusted = (
        labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_trusted)
    )
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return log_ratios(counts(thin.join(F.broadcast(trusted), "doc_id", "left_semi"), buckets), counts(thin, buckets))


def base_columns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with _words, _h (hashes), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(_WS)) != "")
    df = df.withColumn("_words", words(text)).withColumn("_lines", lines)
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_words", F.size("_h").cast("long"))
    h = F.col("_h")
    df = df.withColumn("_w3", F.transform(_indices(F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))
    # Bits for the position: as many as the number of windows needs; the rest is the window's hash.
    bits = F.length(F.bin(F.size("_w3")))
    df = df.withColumn("_bits", bits)
    w3, b = F.col("_w3"), F.col("_bits")
    packed = F.transform(w3, lambda x, i: F.call_function("shiftleft", x, b).bitwiseOR(i.cast("long")))
    df = df.withColumn("_sorted", F.sort_array(packed)).withColumn("_mask", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)
    s, mask = F.col("_sorted"), F.col("_mask")
    key = lambda x: F.get(w3, x.bitwiseAND(mask).cast("int"))
    again = F.filter(s, lambda x, i: F.coalesce(key(F.get(s, i + 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(s, i - 1)) == key(x), F.lit(False)))
    df = df.withColumn("_again", F.sort_array(F.transform(again, lambda x: x.bitwiseAND(mask).cast("int"))))
    a = F.col("_again")
    covered = F.aggregate(F.transform(a, lambda p, i: F.least(F.coalesce(F.get(a, i + 1) - p, F.lit(3)), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    return (
        df.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", covered)
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("_words", "_lines", "_w3", "_bits", "_sorted", "_mask", "_again")
    )


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """doc_id, the base counts, base_failed, ratio and kept of every document."""
    table = F.split(F.lit(",".join(map(repr, fit(docs, labels, max_trusted, buckets)))), ",").cast("array<double>")  # folded into a constant
    df = base_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    h = F.col("_h")
    weight = lambda x: F.get(table, F.pmod(x, F.lit(buckets)).cast("int"))
    single = F.aggregate(h, F.lit(0.0), lambda t, x: t + weight(x))
    pairs = F.aggregate(_indices(F.size(h) - 1), F.lit(0.0), lambda t, i: t + weight(F.xxhash64(F.get(h, i), F.get(h, i + 1))))
    n = F.size(h) + F.greatest(F.size(h) - 1, F.lit(0))
    ratio = F.when(n > 0, (single + pairs) / n).otherwise(F.lit(0.0))
    return df.withColumn("ratio", ratio).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"))
