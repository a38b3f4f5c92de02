"""Operators that look at neighbours or at all rows before: scan, pairwise, sliding windows, buffers, distinct."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..flow import Flow
from ..ordering import lane, ranked, running
from .folds import Scan, fold

WINDOWED = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "variance": F.var_pop, "std": F.stddev_pop, "collect": F.collect_list}


def scan(flow: Flow, fn: str | Callable, init=None, name: str = "scan", returns: str | None = None) -> Flow:
    """A running fold: one output a row, the seed is not emitted.

    fn: "sum", "count", "min", "max" or "last" stay inside the JVM; a Python function (state, value) -> state
    runs once a row in order, with `returns` as the DDL type of the state. Without a key such a function
    needs all rows in one place, whatever the engine; give a key where there is one.
    """
    if isinstance(fn, str):
        out = running(flow.df, flow.order, {name: (fn, flow.column())}, flow.key, flow.wide)
        if init is not None:
            seed = F.lit(init)
            if fn in ("sum", "count"):
                out = out.withColumn(name, F.coalesce(F.col(name) + seed, seed))
            elif fn in ("min", "max"):
                out = out.withColumn(name, (F.least if fn == "min" else F.greatest)(F.col(name), seed))
        return flow.of(out, value=name)
    if returns is None:
        raise ValueError("scan with a Python function needs the type it returns")
    return flow.of(fold(flow, Scan(fn, init, flow.value), {name: returns}), value=name)


def pairwise(flow: Flow, prev: str = "prev", cur: str = "cur") -> Flow:
    """The row before and the current value, from the second row on."""
    on = lane(flow.df, flow.order, flow.key, before=1, wide=flow.wide)
    w = on.window()
    out = on.df.withColumn(prev, F.lag(flow.value).over(w)).withColumn(cur, F.col(flow.value)).filter(F.col("_rn") > 1)
    return flow.of(on.close(out).drop("_rn"), value=cur)


def windowed(flow: Flow, n: int, op: str, name: str | None = None, step: int = 1) -> Flow:
    """Aggregates of n rows, full windows only, sliding by `step` rows."""
    if not isinstance(n, int) or n <= 0 or not isinstance(step, int) or step <= 0:
        raise ValueError("window and step must be whole numbers above 0")
    if op not in WINDOWED:
        raise ValueError(f"unknown window operation {op!r}")
    name = name or op
    on = lane(flow.df, flow.order, flow.key, before=n - 1, wide=flow.wide)
    w = on.window().rowsBetween(-(n - 1), 0)
    out = on.df.withColumn(name, WINDOWED[op](flow.value).over(w)).filter((F.col("_rn") >= n) & ((F.col("_rn") - n) % step == 0))
    return flow.of(on.close(out).drop("_rn"), value=name)


def buffer(flow: Flow, n: int, name: str = "items") -> Flow:
    """Chunks of n values in order, the last one may be shorter; n below 1 gives single values."""
    n = max(int(n), 1)
    rows = ranked(flow.df, flow.order, flow.key, wide=flow.wide).withColumn("chunk", F.floor((F.col("_rn") - 1) / n).cast("long"))
    packed = F.array_sort(F.collect_list(F.struct("_rn", F.col(flow.value).alias("v"))))
    out = rows.groupBy(*flow.key, "chunk").agg(F.transform(packed, lambda x: x["v"]).alias(name))
    return flow.of(out, order=("chunk",), time=None, value=name)


def distinct(flow: Flow) -> Flow:
    """The first row of each value (and key); nulls are one value.

    An aggregate keeps the row with the least order tuple, and combines before the shuffle, so a common value
    costs one whole row a task.
    """
    by = [*flow.key, flow.value]
    rest = [c for c in flow.df.columns if c not in by]
    first = flow.df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*flow.order)).alias("_row"))
    return flow.of(first.select(*by, "_row.*").select(*flow.df.columns))


def distinct_until_changed(flow: Flow) -> Flow:
    """Rows whose value differs from the one before; the first always stays, null equals null, NaN equals NaN."""
    on = lane(flow.df, flow.order, flow.key, before=1, wide=flow.wide)
    out = on.df.withColumn("_prev", F.lag(flow.value).over(on.window()))
    out = out.filter((F.col("_rn") == 1) | ~F.col(flow.value).eqNullSafe(F.col("_prev")))
    return flow.of(on.close(out).drop("_rn", "_prev"))


def frame_spec(key: tuple[str, ...], order: tuple[str, ...], n: int):
    """The frame of n rows that ends at the current one, for callers with aggregates of their own."""
    return W.partitionBy(*key).orderBy(*order).rowsBetween(-(n - 1), 0)
