"""What the corpus operators share: table readers, the shared folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The token rule that several contracts name: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names; only on a single machine that names none, to one of ours."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("on a cluster, name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(named or "/tmp/checkpoints/tidemark")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokens_lower(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8 (bytes.lower and bytes.split touch ASCII alone)."""
    return text.encode().lower().split() if text else []


def plus(df: DataFrame, **columns: str) -> T.StructType:
    """df's schema with further columns, given as DDL types."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in columns.items())).fields])


def boxed(df: DataFrame, name: str = "row") -> Column:
    """All columns of df as one struct, so that no name of theirs meets one of an operator's; `select("row.*")` opens it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, as after a checkpoint.

    Events that wait for listeners still hold their plans, so those go first; and Spark's cleaner works behind the
    collector's back, so what one round frees may be what holds the rest.
    """
    sc = spark.sparkContext
    try:
        sc._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    except Py4JJavaError:
        pass  # a busy listener: files go later
    for _ in range(2):
        gc.collect()
        sc._jvm.System.gc()
        time.sleep(0.5)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a stage wrote, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Shelf:
    """Tables that cut lineage, in a folder of their own under the shared one; those that nothing reads any more can go."""

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        self.spark, self.at = spark, f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        """Writes df, by the values of some columns if asked, and reads it back with its columns in their order."""
        df.write.partitionBy(*by).option("compression", "uncompressed" if by else "snappy").parquet(f"{self.at}/{name}")
        return self.get(name, df.schema)

    def get(self, name: str, schema) -> DataFrame:
        columns = schema.fieldNames() if isinstance(schema, T.StructType) else T._parse_datatype_string(schema).fieldNames()
        return self.spark.read.schema(schema).parquet(f"{self.at}/{name}").select(*[F.col(f"`{c}`") for c in columns])

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.at}/{name}")


def trim() -> None:
    """Gives freed memory back to the system, so that a reused Python worker does not carry one stage's peak through the next."""
    pa.default_memory_pool().release_unused()
    if (give_back := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        give_back(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, with the worker's memory trimmed after each task."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return df.mapInArrow(tidy, schema)


def slices(batch: pa.RecordBatch, column: int | str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `size` bytes of text each; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    cuts = np.flatnonzero(np.diff(upto // size, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(upto)], strict=True):
        yield batch.slice(int(a), int(b - a))
