"""Failing elements: dropped, rescued, or the end of the flow.

`attempt` evaluates an expression that gives null on failure (Spark's try_ functions) with a condition
that tells failure from a plain null. `attempt_python` runs a Python function on Arrow batches and
catches what it raises, with retries; `attempt_async` awaits a coroutine function, many calls at a time. All give an Attempt, whose policy is chosen last.
"""

from __future__ import annotations

import asyncio
import time
from collections.abc import Awaitable, Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..flow import Expr, Flow
from ..ordering import running


@dataclass(frozen=True)
class Attempt:
    """A flow with `_failed` and `_error` beside its value."""

    flow: Flow

    def _clean(self, df) -> Flow:
        return self.flow.of(df.drop("_failed", "_error"))

    def drop(self) -> Flow:
        """Failing elements are left out; the flow goes on."""
        return self._clean(self.flow.df.filter(~F.col("_failed")))

    def rescue(self, handler: Any, drop_null: bool = True) -> Flow:
        """The handler's value (a literal, a column, or a function of the error column) takes a failing element's place.

        A null from the handler drops the element, unless drop_null is false. Operators applied before the
        policy is chosen see the failing element's null; apply them to `drop()` or after the rescue.
        """
        value = handler(F.col("_error")) if callable(handler) and not isinstance(handler, Column) else handler if isinstance(handler, Column) else F.lit(handler)
        kind = self.flow.df.schema[self.flow.value].dataType
        out = self.flow.df.withColumn(self.flow.value, F.when(F.col("_failed"), value.cast(kind)).otherwise(F.col(self.flow.value)))
        if drop_null:
            out = out.filter(~(F.col("_failed") & F.col(self.flow.value).isNull()))
        return self._clean(out)

    def terminate(self) -> Flow:
        """Only what precedes the first failing element (of each key)."""
        f = self.flow
        out = running(f.df, f.order, {"_fails": ("sum", F.col("_failed").cast("long"))}, f.key, f.wide)
        return self._clean(out.filter(F.col("_fails") == 0).drop("_fails"))

    def errors(self) -> Flow:
        return self.flow.of(self.flow.df.filter("_failed"))


def attempt(flow: Flow, expr: Expr, failed: Expr | None = None, name: str | None = None) -> Attempt:
    """failed: a condition on the value before; by default, a null result of a value that was not null."""
    name = name or flow.value
    result = flow.column(expr)
    bad = flow.column(failed) if failed is not None else (result.isNull() & F.col(flow.value).isNotNull())
    df = flow.df.withColumns({"_failed": F.coalesce(bad, F.lit(False)), name: result})
    return Attempt(flow.of(df.withColumn("_error", F.when(F.col("_failed"), F.lit("failed"))), value=name))


def _attempts(flow: Flow, call_all: Callable[[list], list[tuple]], returns: str, name: str | None) -> Attempt:
    """call_all: values of a batch -> (result, failed, error) of each, in their order."""
    name = name or flow.value
    schema = T.StructType([*[f for f in flow.df.schema.fields if f.name != name], *T._parse_datatype_string(f"`{name}` {returns}, _failed boolean, _error string").fields])
    rest, value = [f.name for f in schema.fields[:-3]], flow.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            got = call_all(batch.column(value).to_pylist())
            extra = [pa.array([g[0] for g in got], to_arrow_type(schema[name].dataType)), pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.select(rest).columns, *extra], names=[*rest, name, "_failed", "_error"])

    return Attempt(flow.of(flow.df.mapInArrow(run, schema), value=name))


def attempt_python(flow: Flow, fn: Callable[[Any], Any], returns: str, retries: int = 0, delay_ms: int = 0, name: str | None = None) -> Attempt:
    """fn on each value, batch by batch; an exception is kept as the element's error.

    A call is tried again up to `retries` times, after delay_ms, 2 delay_ms, and so on.
    """

    def call(x: Any) -> tuple[Any, bool, str | None]:
        for k in range(retries + 1):
            try:
                return fn(x), False, None
            except Exception as err:
                if k == retries:
                    return None, True, f"{type(err).__name__}: {err}"
                time.sleep(delay_ms * (k + 1) / 1000)
        raise AssertionError

    return _attempts(flow, lambda values: list(map(call, values)), returns, name)


IN_FLIGHT = 256


def attempt_async(flow: Flow, fn: Callable[[Any], Awaitable[Any]], returns: str, in_flight: int = IN_FLIGHT, retries: int = 0, delay_ms: int = 0, name: str | None = None) -> Attempt:
    """Like attempt_python with a coroutine function: up to `in_flight` calls of a task wait at the same time.

    Results keep the order of their values, whichever comes back first.
    """
    if in_flight < 1:
        raise ValueError("at least one call must be in flight")

    async def call(x: Any, gate: asyncio.Semaphore) -> tuple[Any, bool, str | None]:
        for k in range(retries + 1):
            try:
                async with gate:
                    return await fn(x), False, None
            except Exception as err:
                if k == retries:
                    return None, True, f"{type(err).__name__}: {err}"
                await asyncio.sleep(delay_ms * (k + 1) / 1000)
        raise AssertionError

    async def every(values: list) -> list[tuple]:
        gate = asyncio.Semaphore(in_flight)
        return await asyncio.gather(*[call(x, gate) for x in values])

    return _attempts(flow, lambda values: asyncio.run(every(values)), returns, name)


def retry(action: Callable[[], Any], most: int = 3, delay_ms: int = 1000, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Runs an action of the driver (starting a query, writing a table) again on failure, with a linear wait."""
    for k in range(most + 1):
        try:
            return action()
        except Exception:
            if k == most:
                raise
            sleep(delay_ms * (k + 1) / 1000)
    raise AssertionError
