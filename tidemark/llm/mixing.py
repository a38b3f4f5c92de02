"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Targets: sources in code point order (null last) take the weights in turn and share a multiple of all
sizes; none may exceed a multiple of its own size, and what is cut off goes to the others by weight.
That is one water level L with target_i = min(cap_i, L w_i): sorted by cap_i / w_i the sources at their
cap come first, so running sums over the sources find L: the highest level that its own source can hold.

Sampling: within a source every document expects the same number of copies, target / size. Their prefix
sum is the document's rank times that rate; with one random offset u for the source a document is emitted
once for each integer in (rate (rank - 1) + u, rate rank + u]. Ranks follow the size (class of the size,
then block, then size, id and a hash of the text), so that the words taken stay near the target. No rank
needs a source in one task: counts by source and class, and by block of a class, are summed before they are
summed up, and only rows of one block (1 of BLOCKS in a class, by a hash of id and text) are sorted together.
Where all sources meet in one task, there is a row for each source, or for each block of one source's class.

Defined cases: null text has size 0; sizes 0 everywhere make targets 0; null sources are one source, the
last; a null id sorts first and its text alone gives the block; `mix` ranks rows of one id and text by a hash
of all columns, so a rerun repeats the same rows; equal rows get different ranks, in any order, with the same
result for the group; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, boxed, checkpointed

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
BLOCKS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> with target. Rows: the sources; its windows see a row for each source."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int") + 1)
    t = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * cap)
    upto = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.partitionBy()
    t = (
        t.withColumn("_caps", F.sum("_cap").over(upto) - F.col("_cap"))
        .withColumn("_left", F.sum("_w").over(everything) - F.sum("_w").over(upto) + F.col("_w"))
        .withColumn("_level", (F.sum("source_size").over(everything) * share - F.col("_caps")) / F.col("_left"))
        .withColumn("_level", F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(everything))
    )
    return t.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def _offset(source: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit(""))).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


def text_mark(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def with_copies(rows: DataFrame, mark: str, *ties: str, seed: str = "mix|") -> DataFrame:
    """doc_id, source, size and any further columns -> with source_size, target and copies; every row stays.

    mark: the column with the text's hash; ties: columns that rank rows of equal size, id and mark. One shuffle of the rows, by block of a source's size class; the tables of counts are tiny beside it.
    """
    own = rows.columns
    rows = (
        rows.withColumn("_class", F.length(F.bin("size")))
        .withColumn("_block", (F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), mark).cast("binary")), 1, 6), 16, 10).cast("int") % BLOCKS))
        # One key for the join and the window, so that one shuffle serves both; null sources have a key as well.
        .withColumn("_key", F.concat_ws("|", F.col("_class"), F.col("_block"), F.hex(F.coalesce(F.col("source"), F.lit("\u0001null")))))
    )
    blocks = rows.groupBy("_key", "source", "_class", "_block").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"))
    classes = blocks.groupBy("source", "_class").agg(F.sum("_n").alias("_n"), F.sum("_words").alias("_words"))
    per_source = targets(classes.groupBy("source").agg(F.sum("_words").alias("source_size")))
    before = W.partitionBy("source").orderBy("_class").rowsBetween(W.unboundedPreceding, -1)
    classes = classes.select(F.col("source").alias("_s"), F.col("_class").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = W.partitionBy("source", "_class").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        blocks.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(classes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")))
        .join(per_source.withColumnRenamed("source", "_t"), F.col("source").eqNullSafe(F.col("_t")))
        .select("_key", (F.col("_first") + F.col("_in")).alias("_start"), "source_size", "target")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = _offset(F.col("source"), seed)
    order = W.partitionBy("_key").orderBy("size", "doc_id", mark, *ties)
    ranked = rows.withColumn("_rank", F.row_number().over(order)).join(starts, "_key").withColumn("_at", F.col("_start") + F.col("_rank"))
    copies = F.floor(F.col("_at") * rate + u) - F.floor((F.col("_at") - 1) * rate + u)
    return ranked.select(*own, "source_size", "target", copies.cast("long").alias("copies"))


def mix(df: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: str = "mix|") -> DataFrame:
    """df with each row repeated as often as the mix takes it; the columns are df's own, whatever their names."""
    text = F.col(text_col).cast("string")
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])
    rows = df.select(boxed(df), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), text_mark(text).alias("mark"), hashed.alias("hash"))
    taken = with_copies(rows, "mark", "hash", seed=seed).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document. Texts are read once; four narrow columns are kept of them."""
    text = F.col("text").cast("string")
    thin = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), text_mark(text).alias("mark")))
    return with_copies(thin, "mark").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS mark FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source
), c AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(cap) OVER q - cap)) / (sum(w) OVER () - sum(w) OVER q + w) AS lev FROM c
  WINDOW q AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT max(lev) FROM l WHERE lev * w <= cap) * w, cap)) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('mix|' || coalesce(d.source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)), CAST('0x' || substr(md5(concat_ws('|', CAST(d.doc_id AS VARCHAR), d.mark)), 1, 6) AS BIGINT) % 1024, d.size, d.doc_id NULLS FIRST, d.mark) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM e
"""
