"""The queries opN_<name>, and their DuckDB SQL where SQL can express them.

Of three operators SQL can express a part of the result; those columns are queries of their own, over the
same whole tables: media_payloads, rules_base and urls_fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm, media, mixing, pieces, quality, rules, simhash, suffixes, toxicity, urls
from .common import table


def piece_model() -> str:
    """The 32k piece model's file; named on the driver, the same place on each machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media_columns(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), piece_model())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return rules.base_columns(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *names)


def urls_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and the fixed rule of every page, with that rule's verdict."""
    url = F.col("url").cast("string")
    parts = table(spark, sf_dir, "pages").select("page_id", urls.host(url).alias("host"), urls.path(url).alias("path"))
    rule, verdict = urls.fixed_rule(F.col("host"), F.col("path"))
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


_PAYLOAD_SQL = """SELECT doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, CAST(octet_length(raw) + pad AS BIGINT) AS payload_bytes, sha256(raw || repeat('\\x00'::BLOB, pad)) AS payload_sha256
FROM (SELECT doc_id, raw, CASE WHEN octet_length(raw) = 0 THEN 64 ELSE (64 - octet_length(raw) % 64) % 64 END AS pad FROM (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents))"""

_BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT r, k, CAST(w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS VARCHAR) AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
a AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, win) AS n FROM p) WHERE n > 1),
c AS (SELECT r, count(DISTINCT k + o) AS n FROM a, (VALUES (0), (1), (2)) t(o) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN c USING (r) LEFT JOIN l USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""

_FITS = " ".join(
    f"WHEN (host = '{r[: r.index('/')]}' OR ends_with(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/') :]}') THEN {{{k}}}"
    for k, (_, r) in enumerate(sorted(urls.RULES, key=lambda x: (-len(x[1]), x[1])))
)
_LONGEST_FIRST = sorted(urls.RULES, key=lambda x: (-len(x[1]), x[1]))
_FIXED_SQL = f"""SELECT page_id, host, path, CASE {_FITS.format(*[f"'{r}'" for _, r in _LONGEST_FIRST])} END AS rule, CASE {_FITS.format(*[f"'{k}'" for k, _ in _LONGEST_FIRST])} END AS verdict FROM
(SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM
(SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages))"""


def queries():
    return {
        "op1_media": op1_media,
        "op2_pieces": op2_pieces,
        "op3_toxicity": op3_toxicity,
        "op4_suffixes": op4_suffixes,
        "op5_lm": op5_lm,
        "op6_quality": op6_quality,
        "op7_mixing": op7_mixing,
        "op8_simhash": op8_simhash,
        "op9_rules": op9_rules,
        "op10_urls": op10_urls,
        "media_payloads": media_payloads,
        "rules_base": rules_base,
        "urls_fixed": urls_fixed,
    }


def oracles():
    return {"op7_mixing": mixing.ORACLE, "media_payloads": _PAYLOAD_SQL, "rules_base": _BASE_SQL, "urls_fixed": _FIXED_SQL}
