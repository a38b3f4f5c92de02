"""Operators in event time: debounce, throttle, buffers by time, the windowed rate limiter.

Milliseconds are counted from the time column, to the microsecond where windows decide. Borders:
debounce and throttle pass at a gap of exactly `ms`; buffers hold [start, start + ms); the limiter
looks at (t - window, t].
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..flow import Flow
from ..ordering import lane
from .folds import RateLimit, Throttle, fold


def _positive(ms: int) -> int:
    if not isinstance(ms, int) or ms < 0:
        raise ValueError("milliseconds must be a whole number from 0")
    return ms


def micros(flow: Flow) -> Column:
    if not flow.time:
        raise ValueError("this operator needs the flow's time column")
    return F.unix_micros(F.col(flow.time).cast("timestamp")) if "timestamp" in dict(flow.df.dtypes)[flow.time] else F.col(flow.time).cast("long") * 1000


def debounce(flow: Flow, ms: int) -> Flow:
    """Rows with no successor within ms; the last row always passes."""
    _positive(ms)
    on = lane(flow.df.withColumn("_us", micros(flow)), flow.order, flow.key, after=1, wide=flow.wide)
    nxt = F.lead("_us").over(on.window())
    out = on.df.withColumn("_gap", nxt - F.col("_us"))
    out = out.filter(F.col("_gap").isNull() | (F.col("_gap") >= ms * 1000))
    return flow.of(on.close(out).drop("_rn", "_us", "_gap"))


def throttle(flow: Flow, ms: int) -> Flow:
    """Rows at least ms after the last row that passed; the first always passes. Greedy, so a fold."""
    return flow.of(fold(flow, Throttle(_positive(ms)), {}))


def rate_limit(flow: Flow, window_ms: int, most: int, name: str = "accepted", rate: str = "rate") -> Flow:
    """Adds whether the limiter accepts each row, and the accepted rows a second in the window then."""
    if _positive(window_ms) == 0 or most < 0:
        raise ValueError("the window must be above 0 and the maximum not below 0")
    return flow.of(fold(flow, RateLimit(window_ms, most), {name: "boolean", rate: "double"}))


def buffer_time(flow: Flow, ms: int, name: str = "items") -> Flow:
    """Values by windows of ms from the first row's time (of each key); empty windows do not appear."""
    if _positive(ms) == 0:
        raise ValueError("a window needs a length")
    rows = flow.df.withColumn("_us", micros(flow))
    starts = rows.groupBy(*flow.key).agg(F.min("_us").alias("_start"))
    rows = rows.join(starts, list(flow.key)) if flow.key else rows.crossJoin(F.broadcast(starts))  # one row
    rows = rows.withColumn("window", F.floor((F.col("_us") - F.col("_start")) / (ms * 1000)).cast("long"))
    packed = F.array_sort(F.collect_list(F.struct(*flow.order, F.col(flow.value).alias("_v"))))
    out = rows.groupBy(*flow.key, "window").agg(F.transform(packed, lambda x: x["_v"]).alias(name))
    return flow.of(out, order=("window",), time=None, value=name)
