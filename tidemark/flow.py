"""Flow: a DataFrame with an explicit order, and the operators of ordered streams on it.

`order` names the columns that order the rows; the last one should break ties. `key` cuts the flow into
independent streams. `time` is the event-time column of the time operators; `value` the column that an
operator reads and writes where none is named. A flow is immutable and lazy; nothing here collects rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Expr = Column | Callable[[Column], Column]


@dataclass(frozen=True)
class Flow:
    df: DataFrame
    order: tuple[str, ...]
    key: tuple[str, ...] = ()
    time: str | None = None
    value: str = "value"
    #: Cut a keyless order into segments: True, False, or None to decide by the table's estimated size.
    wide: bool | None = None

    def __post_init__(self):
        if isinstance(self.order, str) or isinstance(self.key, str):
            raise TypeError("order and key are sequences of column names")
        object.__setattr__(self, "order", tuple(self.order))
        object.__setattr__(self, "key", tuple(self.key))
        if not self.order:
            raise ValueError("a flow needs an order")
        missing = [c for c in (*self.order, *self.key, *([self.time] if self.time else [])) if c not in self.df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")

    def of(self, df: DataFrame, **changes) -> Flow:
        return replace(self, df=df, **changes)

    def column(self, expr: Expr | None = None) -> Column:
        """An expression over the value column."""
        v = F.col(self.value)
        return v if expr is None else expr(v) if callable(expr) and not isinstance(expr, Column) else expr

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.key, *self.order)

    def pipe(self, *operators: Callable[[Flow], Flow]) -> Flow:
        """Applies operators given as functions of a flow, left to right."""
        out = self
        for operator in operators:
            out = operator(out)
        return out

    # projection, filter, limit
    def map(self, expr: Expr, drop_null: bool = False, name: str | None = None) -> Flow:
        from .operators import basic

        return basic.map_values(self, expr, drop_null, name)

    def filter(self, pred: Expr) -> Flow:
        from .operators import basic

        return basic.filter_rows(self, pred)

    def take(self, n: int) -> Flow:
        from .operators import basic

        return basic.take(self, n)

    def skip(self, n: int) -> Flow:
        from .operators import basic

        return basic.skip(self, n)

    def start_with(self, *values) -> Flow:
        from .operators import basic

        return basic.start_with(self, *values)

    def fork(self, pred: Expr) -> tuple[Flow, Flow]:
        from .operators import basic

        return basic.fork(self, pred)

    def merge(self, *others: Flow) -> Flow:
        from .operators import combine

        return combine.merge(self, *others)

    # sequence
    def scan(self, fn, init=None, name: str = "scan", returns: str | None = None) -> Flow:
        from .operators import sequence

        return sequence.scan(self, fn, init, name, returns)

    def pairwise(self, prev: str = "prev", cur: str = "cur") -> Flow:
        from .operators import sequence

        return sequence.pairwise(self, prev, cur)

    def windowed(self, n: int, op: str, name: str | None = None, step: int = 1) -> Flow:
        from .operators import sequence

        return sequence.windowed(self, n, op, name, step)

    def buffer(self, n: int) -> Flow:
        from .operators import sequence

        return sequence.buffer(self, n)

    def distinct(self) -> Flow:
        from .operators import sequence

        return sequence.distinct(self)

    def distinct_until_changed(self) -> Flow:
        from .operators import sequence

        return sequence.distinct_until_changed(self)

    # time
    def debounce(self, ms: int) -> Flow:
        from .operators import timing

        return timing.debounce(self, ms)

    def throttle(self, ms: int) -> Flow:
        from .operators import timing

        return timing.throttle(self, ms)

    def buffer_time(self, ms: int) -> Flow:
        from .operators import timing

        return timing.buffer_time(self, ms)

    # flattening
    def concat_map(self, items: Expr) -> Flow:
        from .operators import combine

        return combine.concat_map(self, items)

    # terminals: frames of one row, or of one row a key
    def reduce(self, fn, init=None, returns: str | None = None) -> DataFrame:
        from .operators import terminals

        return terminals.reduce(self, fn, init, returns)

    def sum(self) -> DataFrame:
        from .operators import terminals

        return terminals.total(self)

    def min(self) -> DataFrame:
        from .operators import terminals

        return terminals.least(self)

    def max(self) -> DataFrame:
        from .operators import terminals

        return terminals.greatest(self)

    def mean(self) -> DataFrame:
        from .operators import terminals

        return terminals.mean(self)

    def count(self) -> DataFrame:
        from .operators import terminals

        return terminals.count(self)

    def first(self) -> DataFrame:
        from .operators import terminals

        return terminals.first(self)

    def last(self) -> DataFrame:
        from .operators import terminals

        return terminals.last(self)

    def find(self, pred: Expr) -> DataFrame:
        from .operators import terminals

        return terminals.find(self, pred)

    def all(self, pred: Expr) -> DataFrame:
        from .operators import terminals

        return terminals.every(self, pred)

    def some(self, pred: Expr) -> DataFrame:
        from .operators import terminals

        return terminals.some(self, pred)

    # sinks
    def to_array(self) -> list:
        from .sources import sinks

        return sinks.to_array(self)

    def observe(self, on_next, on_error=None, on_complete=None, terminate: bool = False):
        from .sources import sinks

        return sinks.observe(self, on_next, on_error, on_complete, terminate)

    def __iter__(self):
        from .sources import sinks

        return sinks.iterate(self)


def flow(df: DataFrame, order: Sequence[str] | str, key: Sequence[str] | str = (), **kw) -> Flow:
    one = lambda x: (x,) if isinstance(x, str) else tuple(x)
    return Flow(df, one(order), one(key), **kw)
