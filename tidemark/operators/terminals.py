"""Terminal aggregates and searches: a frame of one row, or of one row for each key.

Empty flows without a key give their defined row: sum 0, count 0, all true, some false, else null.
All but a Python reduce combine before any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..flow import Expr, Flow
from .folds import Scan, fold


def _agg(flow: Flow, out: Column, name: str) -> DataFrame:
    return flow.df.groupBy(*flow.key).agg(out.alias(name))


def total(flow: Flow, name: str = "sum") -> DataFrame:
    return _agg(flow, F.coalesce(F.sum(flow.value), F.lit(0)), name)


def least(flow: Flow, name: str = "min") -> DataFrame:
    return _agg(flow, F.min(flow.value), name)


def greatest(flow: Flow, name: str = "max") -> DataFrame:
    return _agg(flow, F.max(flow.value), name)


def mean(flow: Flow, name: str = "mean") -> DataFrame:
    return _agg(flow, F.avg(flow.value), name)


def count(flow: Flow, name: str = "count") -> DataFrame:
    return _agg(flow, F.count(F.lit(1)), name)


def first(flow: Flow, name: str = "first") -> DataFrame:
    """The first value, null or not: the struct keeps a null value apart from none."""
    return _agg(flow, F.min_by(F.struct(F.col(flow.value).alias("v")), F.struct(*flow.order)).getField("v"), name)


def last(flow: Flow, name: str = "last") -> DataFrame:
    return _agg(flow, F.max_by(F.struct(F.col(flow.value).alias("v")), F.struct(*flow.order)).getField("v"), name)


def find(flow: Flow, pred: Expr, name: str = "found") -> DataFrame:
    """The first value that satisfies the predicate; keys without one have null."""
    hit = F.coalesce(flow.column(pred).cast("boolean"), F.lit(False))
    order = F.when(hit, F.struct(*flow.order))
    return _agg(flow, F.min_by(F.when(hit, F.struct(F.col(flow.value).alias("v"))), order).getField("v"), name)


def every(flow: Flow, pred: Expr, name: str = "all") -> DataFrame:
    return _agg(flow, F.coalesce(F.bool_and(F.coalesce(flow.column(pred).cast("boolean"), F.lit(False))), F.lit(True)), name)


def some(flow: Flow, pred: Expr, name: str = "some") -> DataFrame:
    return _agg(flow, F.coalesce(F.bool_or(F.coalesce(flow.column(pred).cast("boolean"), F.lit(False))), F.lit(False)), name)


def reduce(flow: Flow, fn: str | Callable, init=None, returns: str | None = None, name: str = "reduce") -> DataFrame:
    """The last state of a fold. "sum", "min", "max" and "count" are plain aggregates with a seed.

    A Python function sees the rows in order, key by key; without a key that is one task's work.
    """
    if isinstance(fn, str):
        known = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
        if fn not in known:
            raise ValueError(f"unknown reduction {fn!r}")
        got = known[fn](flow.value)
        if init is not None:
            seed = F.lit(init)
            got = F.coalesce(got + seed, seed) if fn in ("sum", "count") else (F.least if fn == "min" else F.greatest)(got, seed)
        return _agg(flow, got, name)
    if returns is None:
        raise ValueError("reduce with a Python function needs the type it returns")
    states = fold(flow, Scan(fn, init, flow.value), {"_state": returns})
    out = states.groupBy(*flow.key).agg(F.max_by(F.struct("_state"), F.struct(*flow.order)).getField("_state").alias(name))
    return out if flow.key or init is None else out.withColumn(name, F.coalesce(F.col(name), F.lit(init).cast(returns)))
