"""Where queries and the DuckDB SQL that they are held against are registered, name by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..flow import Flow

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, keyed: bool = True, **kw) -> Flow:
    """events in (ts, event_id) order, by user unless keyed is false."""
    return Flow(table(spark, sf_dir, "events"), ("ts", "event_id"), ("user_id",) if keyed else (), "ts", **kw)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of ours on a single machine that names none."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, name a shared folder in spark.checkpoint.dir")
    return named or "/tmp/checkpoints/tidemark"
