"""From raw documents to training tokens: five stages, each one of the corpus operators.

1. quality: rows that the factorisation machine rejects go (operator 6, its threshold of 0.3).
2. near_duplicates: one document of each SimHash component stays, the one with the least id (operator 8).
3. repeats: bytes in 50-byte strings that also start in a document with a smaller id go from the text,
   and n_chars follows; characters cut in half are dropped; rows stay, even if no text is left (operator 4).
4. mixture: rows are repeated or left out so that sources near their target sizes (operator 7).
5. pieces: texts become piece ids, with an end id, and the text that those decode to (operator 2).

Each function takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame; all but the last
return the columns of docs. Empty tables go through; null texts count as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, pieces, quality, simhash, suffixes
from tidemark.llm.common import ensure_checkpoint_dir, remove, table
from tidemark.llm.registry import piece_model


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.encode_texts(docs.select("doc_id", "lang", "source", "text"), piece_model())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("mixture", mixture_stage),
    ("pieces", piece_stage),
]

#: Models, fingerprints and piece ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages the rows are written as Parquet in the shared folder and read again.

    A stage's folder goes once the next one is written; the last of them stays, as the result is read from it.
    """
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            remove(spark, f"{place}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
