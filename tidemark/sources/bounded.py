"""Bounded sources. Each gives a Flow whose order is explicit from the start."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..flow import Flow

ORDINAL = "ord"


def from_values(spark: SparkSession, values: Iterable[Any], kind: str | T.DataType | None = None, value: str = "value") -> Flow:
    """A list, a generator, a numpy array or any other iterable; its order is the ordinal column."""
    items = [v.item() if hasattr(v, "item") and not isinstance(v, (list, tuple)) else v for v in values]
    if kind is None:
        known = [v for v in items if v is not None]
        if not known:
            raise ValueError("values without a type need `kind`")
        numbers = all(type(v) in (int, float) for v in known)
        kind = T.DoubleType() if numbers and any(type(v) is float for v in known) else T._infer_type(known[0])
    name = kind if isinstance(kind, str) else kind.simpleString()
    if name in ("double", "float"):
        items = [float(v) if v is not None else None for v in items]
    df = spark.createDataFrame(list(enumerate(items)), f"{ORDINAL} long not null, `{value}` {name}")
    return Flow(df, (ORDINAL,), value=value)


def of(spark: SparkSession, *values: Any, kind: str | None = None) -> Flow:
    return from_values(spark, values, kind)


def empty(spark: SparkSession, kind: str = "long", value: str = "value") -> Flow:
    return from_values(spark, [], kind, value)


def range_(spark: SparkSession, start: float, end: float, step: float = 1, value: str = "value") -> Flow:
    """start, start + step, ... below end; made by the executors. A step of 0 or less is an error."""
    if not step > 0:
        raise ValueError("the step must be above 0")
    n = max(0, math.ceil((end - start) / step))
    whole = all(isinstance(x, int) for x in (start, end, step))
    df = spark.range(n).select(F.col("id").alias(ORDINAL), (F.col("id") * step + start).cast("long" if whole else "double").alias(value))
    return Flow(df, (ORDINAL,), value=value)


def from_callable(spark: SparkSession, make: Callable[[], Any], kind: str = "string", value: str = "value") -> Flow:
    """One element, made when the flow runs (once for each run, in a task)."""

    def run(_):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in _:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([make()], to_arrow_type(out[value].dataType))], names=[ORDINAL, value])

    out = T._parse_datatype_string(f"{ORDINAL} long, `{value}` {kind}")
    return Flow(spark.range(0, 1, 1, 1).mapInArrow(run, out), (ORDINAL,), value=value)


def from_table(df: DataFrame, order: Sequence[str], key: Sequence[str] = (), time: str | None = None, value: str = "value") -> Flow:
    return Flow(df, tuple(order), tuple(key), time, value)


def from_parquet(spark: SparkSession, path: str, order: Sequence[str], **kw) -> Flow:
    return from_table(spark.read.parquet(path), order, **kw)


def from_ndjson(spark: SparkSession, path: str, schema: str, order: Sequence[str], **kw) -> Flow:
    """JSON lines; broken lines give null columns."""
    return from_table(spark.read.schema(schema).json(path), order, **kw)


def from_vector(spark: SparkSession, vector: Sequence[float], kind: str = "array<float>") -> Flow:
    """A typed array as one element."""
    return from_values(spark, [list(map(float, vector))], kind)
