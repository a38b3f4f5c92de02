"""Ordered operators on unbounded input: keyed state in Structured Streaming.

A stream has no global order to sort by, so each operator works by key: rows run through the same steps as
in batch, in order within their key, with the state carried on. A stream without a key is one key, and one
task's work.

With a watermark on the flow's time (the first of its order), rows are held in state until the watermark has
passed them, so what comes out does not depend on how rows fall into micro-batches; rows behind the watermark
are late and left out by Spark. Without one, a micro-batch is sorted and handled at once, and rows that come
before one handled in an earlier micro-batch are late and left out. Equal rows all count.

Keys are dealt over BUCKETS rows of state by their hash, as handling a row of state costs more than a key's step does:
each holds its keys' states, and the rows that wait, column by column. A step that has `several` sees all ready rows of
its keys at once, as arrays; others are called row by row, with the columns that they read. With `idle_ms` a key is
forgotten, and what its step still has comes out, once the watermark has passed its last row by so much.
"""

from __future__ import annotations

import pickle
import warnings
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..flow import Flow
from ..operators.folds import RateLimit, Scan, Step, Throttle

BUCKETS = 1 << 12
#: The milliseconds of rows without a time, which come first.
NEVER = -(1 << 62)
#: Rows that wait: their columns, their keys, and the place of each row's key among those.
Rows = tuple[dict[str, np.ndarray], list[tuple], np.ndarray]


@dataclass
class Skip(Step):
    n: int

    def reads(self):
        return ()

    def init(self):
        return 0

    def step(self, seen, row):
        return (seen, ()) if seen >= self.n else (seen + 1, None)


@dataclass
class Take(Step):
    n: int

    def reads(self):
        return ()

    def init(self):
        return 0

    def step(self, seen, row):
        return (seen + 1, ()) if seen < self.n else (seen, None)


@dataclass
class Pairwise(Step):
    value: str

    def reads(self):
        return (self.value,)

    def step(self, state, row):
        return (row[self.value],), None if state is None else (state[0], row[self.value])


@dataclass
class Changed(Step):
    value: str

    def reads(self):
        return (self.value,)

    def step(self, state, row):
        v = row[self.value]
        same = state is not None and (state[0] == v or (state[0] != state[0] and v != v))
        return (v,), None if same else ()


@dataclass
class Windowed(Step):
    n: int
    op: str
    value: str

    def reads(self):
        return (self.value,)

    def init(self):
        return deque(maxlen=self.n)

    def step(self, last, row):
        last.append(row[self.value])
        if len(last) < self.n:
            return last, None
        values = [v for v in last if v is not None]
        if not values:
            return last, (None,)
        mean = sum(values) / len(values)
        var = sum((v - mean) ** 2 for v in values) / len(values)
        return last, ({"mean": mean, "sum": sum(values), "min": min(values), "max": max(values), "variance": var, "std": var**0.5}[self.op],)


@dataclass
class Latest(Step):
    """Latest value of each of some sources, once all were seen; with `main`, at that source's rows only."""

    sources: tuple
    tag: str
    value: str
    main: Any = None

    def reads(self):
        return self.tag, self.value

    def init(self):
        return {}

    def several(self, held, first, columns, row_at):
        tags, values = columns[self.tag], columns[self.value]
        n, ends = len(tags), [*first[1:].tolist(), len(tags)]
        begins, last = np.repeat(first, np.diff(first, append=n)), np.array(ends) - 1
        seen, made, states = np.ones(n, bool), [], [dict(h) for h in held]
        for source in self.sources:
            at = np.maximum.accumulate(np.where(tags == source, np.arange(n), -1))
            known, latest = at >= begins, values[at]
            for h, lo, hi in zip(held, first.tolist(), ends):
                if source in h:  # of an earlier micro-batch
                    latest = latest.astype(object) if latest.dtype.kind != "O" and latest.dtype.kind != "M" else latest
                    before = np.flatnonzero(~known[lo:hi]) + lo
                    latest[before], known[before] = h[source], True
            for s, k, v in zip(states, known[last], latest[last]):
                if k:
                    s[source] = _item(v)
            seen &= known
            made.append(latest)
        taken = np.flatnonzero(seen if self.main is None else seen & (tags == self.main))
        return states, taken, [latest[taken] for latest in made], []


@dataclass
class Buffer(Step):
    """The last row of each n, with their values; what is left over comes with the last row when the stream ends."""

    n: int
    value: str

    def init(self):
        return [], None

    def step(self, state, row):
        held = [*state[0], row[self.value]]
        return (([], None), (held,)) if len(held) >= self.n else ((held, row), None)

    def finish(self, state):
        return [(state[1], (state[0],))] if state[0] else []


@dataclass
class StartWith(Step):
    """Values before the first row, as rows that have nothing but the key, the value and their place below 0."""

    values: tuple
    value: str
    key: tuple

    def init(self):
        return False

    def step(self, begun, row):
        lead = len(self.values)
        first = [] if begun else [({**dict.fromkeys(row), **{k: row[k] for k in self.key}, self.value: v}, (k - lead,)) for k, v in enumerate(self.values)]
        return True, [*first, (row, (0,))]


@dataclass
class Debounce(Step):
    """Rows without a successor within ms."""

    ms: int

    def reads(self):
        return ("_ms",)

    def several(self, held, first, columns, row_at):
        ms = columns["_ms"]
        last = np.append(first[1:], len(ms)) - 1
        alone = np.append((np.diff(ms) >= self.ms) | (ms[:-1] == NEVER), False)  # a row without a time has no gap
        alone[last] = False
        before = [(row, ()) for row, i in zip(held, first.tolist()) if row is not None and (row["_ms"] is None or ms[i] - row["_ms"] >= self.ms)]
        return [row_at(i) for i in last.tolist()], np.flatnonzero(alone), [], before

    def finish(self, pending):
        return [(pending, ())] if pending is not None else []


def _plain(v: Any, whole: bool = False) -> Any:
    """A value as Python has it; pandas gives whole numbers beside nulls as floats, and nulls among them as NaN."""
    if v is None or v is pd.NaT or (whole and v != v):
        return None
    v = v.item() if isinstance(v, np.generic) else v
    return int(v) if whole else v


def _item(v: Any) -> Any:
    """A value of an array as Python has it."""
    return _plain(pd.Timestamp(v) if isinstance(v, np.datetime64) else v)


def _array(values: pd.Series, whole: bool) -> np.ndarray:
    if values.dtype.kind == "M":
        return values.to_numpy("datetime64[ns]")
    if values.dtype.kind in "iub" or (values.dtype.kind == "f" and not whole):
        return values.to_numpy()
    return np.fromiter((_plain(v, whole) for v in values), object, len(values))


def _listed(name: str, values: np.ndarray) -> list:
    if name == "_ms":
        return [None if v == NEVER else v for v in values.tolist()]
    return [_item(v) for v in values] if values.dtype.kind == "M" else values.tolist()


def _ranks(values: np.ndarray) -> np.ndarray:
    """What orders the values, null first."""
    if values.dtype.kind == "M":
        return values.astype("int64")
    if values.dtype != object:
        return values
    out, rank, before = np.zeros(len(values), "int64"), 0, None
    for i in sorted((i for i, v in enumerate(values) if v is not None), key=values.__getitem__):
        rank, before = rank + (rank == 0 or values[i] != before), values[i]
        out[i] = rank
    return out


def _united(parts: list[Rows]) -> Rows:
    if len(parts) == 1:
        return parts[0]
    index: dict[tuple, int] = {}
    of = [np.array([index.setdefault(k, len(index)) for k in own], "int32")[places] for _, own, places in parts]
    return {c: np.concatenate([p[0][c] for p in parts]) for c in parts[0][0]}, list(index), np.concatenate(of)


def _picked(rows: Rows, which: np.ndarray) -> Rows:
    columns, own, of = rows
    left, of = np.unique(of[which], return_inverse=True)
    return {c: v[which] for c, v in columns.items()}, [own[k] for k in left.tolist()], of.astype("int32")


def _own(df: DataFrame, name: str) -> Column:
    """A key's column as text: pandas confuses null with NaN, and great numbers beside nulls."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0.0).cast(kind)).otherwise(c)  # -0.0 is 0.0
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(c)
    return F.base64(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def _schema(df: DataFrame, keep: list[str], added: dict[str, str]) -> T.StructType:
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name in keep and f.name not in added]
    return T.StructType([*fields, *T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in added.items())).fields])


def has_watermark(df: DataFrame, column: str | None) -> bool:
    return column is not None and "spark.watermarkDelayMs" in df.schema[column].metadata


def with_state(stream: Flow, step: Step, added: dict[str, str], idle_ms: int | None = None) -> DataFrame:
    """stream's rows with the step's values added. idle_ms needs a watermark on the flow's time.

    A step gives None, the values for its row, or a list of (row, values). One with `several(held, first, columns, row_at)`
    gets the states of some keys, where the rows of each begin, the columns that it reads, and a function that makes a row
    of a place; it gives the new states, the places of the rows that pass, the columns of their values, and a list of (row, values).
    """
    df, order = stream.df, list(stream.order)
    hold = has_watermark(df, stream.time) and order[0] == stream.time
    if idle_ms is not None and not hold:
        raise ValueError("to forget idle keys, the flow's time needs a watermark and the first place in its order")
    out = _schema(df, stream.df.columns, added)
    passing, names = [f.name for f in out.fields if f.name not in added], [f.name for f in out.fields]
    times = {f.name for f in out.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}
    finish = getattr(step, "finish", lambda _: [])
    if stream.time:
        df = df.withColumn("_ms", F.coalesce(F.floor(F.unix_micros(F.col(stream.time).cast("timestamp")) / 1000).cast("long"), F.lit(NEVER)))

    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    kept, key = df.columns, [f"_k{k}" for k in range(len(stream.key))]
    df = df.select("*", *[_own(df, c).alias(k) for k, c in zip(key, stream.key)])

    needed = kept if step.reads() is None else list(step.reads())
    several: Callable | None = getattr(step, "several", None)

    def rows_of(part: pd.DataFrame) -> Rows:
        index: dict[tuple, int] = {}
        keys = zip(*[part[k].tolist() for k in key]) if key else repeat((), len(part))
        of = np.fromiter((index.setdefault(k, len(index)) for k in keys), "int32", len(part))
        return {c: _array(part[c], c in whole) for c in kept}, list(index), of

    def each(held: list, first: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[list, list, list, list]:
        """What `several` gives, of a step that has none."""
        taken, made, others, ends = [], [], [], [*first[1:].tolist(), len(columns[order[0]])]
        values = zip(*[_listed(c, columns[c]) for c in needed]) if needed else repeat(())
        for k, (lo, hi) in enumerate(zip(first.tolist(), ends)):
            for i in range(lo, hi):
                held[k], got = step.step(held[k], dict(zip(needed, next(values))))
                if isinstance(got, list):
                    others += got
                elif got is not None:
                    taken.append(i)
                    made.append(got)
        return held, taken, [pd.Series(list(v), dtype="object") for v in zip(*made)], others

    def stepped(keys: dict, rows: Rows) -> Iterator[pd.DataFrame]:
        """Runs the step over rows that are ready, and puts the new states into keys."""
        columns, own, of = rows
        by = np.lexsort([*[_ranks(columns[c]) for c in reversed(order)], of])
        columns, of = {c: v[by] for c, v in columns.items()}, of[by]

        def place(i: int) -> tuple:
            return tuple((False,) if v is None else (True, v) for v in (_item(columns[c][i]) for c in order))

        def begins() -> np.ndarray:
            return np.flatnonzero(np.diff(of, prepend=-1))

        late = np.zeros(len(of), bool)
        for lo, hi in zip(first := begins().tolist(), [*first[1:], len(of)]):
            last = keys.get(own[of[lo]])
            while last is not None and lo < hi and place(lo) < last[1][1]:  # before a row of an earlier micro-batch
                late[lo], lo = True, lo + 1
        if late.any():
            columns, of = {c: v[~late] for c, v in columns.items()}, of[~late]
        if not len(of):
            return
        first = begins()
        mine = [own[k] for k in of[first].tolist()]
        held = [keys[k][0] if k in keys else step.init() for k in mine]
        row_at = lambda i: {c: (None if c == "_ms" and v[i] == NEVER else _item(v[i])) for c, v in columns.items()}
        held, taken, made, others = several(held, first, {c: columns[c] for c in needed}, row_at) if several else each(held, first, columns)
        for k, state, i in zip(mine, held, [*(first[1:] - 1).tolist(), len(of) - 1]):
            keys[k] = state, (int(columns["_ms"][i]) if hold else 0, place(i))
        if len(taken):
            at = np.asarray(taken, "int64")
            yield timed({**{c: columns[c][at] for c in passing}, **dict(zip(added, made))})
        yield from framed(others)

    def framed(made: list) -> Iterator[pd.DataFrame]:
        if made:
            values = zip(*[(*[row[c] for c in passing], *more) for row, more in made])
            yield timed({n: pd.Series(list(v), dtype="object") for n, v in zip(names, values)})

    def timed(made: dict) -> pd.DataFrame:
        """Times are typed, as Spark takes others for UTC."""
        return pd.DataFrame({n: pd.Series(v, dtype="datetime64[ns]") if n in times else v for n, v in made.items()})

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        warnings.filterwarnings("ignore", "The behavior of DataFrame concatenation", FutureWarning)  # of Spark's own padding
        keys, waiting = pickle.loads(state.get[0]) if state.exists else ({}, None)
        passed = state.getCurrentWatermarkMs() if hold else None
        blocks = [*([waiting] if waiting else []), *([] if state.hasTimedOut else (rows_of(p) for p in parts if len(p)))]
        ready, waiting = (_united(blocks) if blocks else None), None
        if ready and hold:
            held = ready[0]["_ms"] >= passed
            if held.all():
                ready, waiting = None, ready
            elif held.any():
                ready, waiting = _picked(ready, ~held), _picked(ready, held)
        if ready:
            yield from stepped(keys, ready)
        due = int(waiting[0]["_ms"].min()) if waiting else None
        if idle_ms is not None:
            busy, gone = set(waiting[1]) if waiting else set(), []
            for own in [k for k, (_, last) in keys.items() if k not in busy and last[0] + idle_ms < passed]:
                gone += finish(keys.pop(own)[0])
            yield from framed(gone)
            due = min([*[due] * (due is not None), *[last[0] + idle_ms for k, (_, last) in keys.items() if k not in busy]], default=None)
        if keys or waiting:
            state.update((pickle.dumps((keys, waiting), pickle.HIGHEST_PROTOCOL),))
            if due is not None:
                state.setTimeoutTimestamp(max(due, passed + 1))
        elif state.exists:
            state.remove()

    timeout = GroupStateTimeout.EventTimeTimeout if hold else GroupStateTimeout.NoTimeout
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)) if key else F.lit(0).cast("long")
    return df.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(run, out, T.StructType([T.StructField("s", T.BinaryType())]), "append", timeout)


def scan(stream: Flow, fn, init, returns: str, name: str = "scan") -> DataFrame:
    return with_state(stream, Scan(fn, init, stream.value), {name: returns})


def skip(stream: Flow, n: int) -> DataFrame:
    return with_state(stream, Skip(n), {})


def take(stream: Flow, n: int) -> DataFrame:
    return with_state(stream, Take(n), {})


def pairwise(stream: Flow) -> DataFrame:
    kind = stream.df.schema[stream.value].dataType.simpleString()
    return with_state(stream, Pairwise(stream.value), {"prev": kind, "cur": kind})


def distinct_until_changed(stream: Flow) -> DataFrame:
    return with_state(stream, Changed(stream.value), {})


def distinct(stream: Flow, idle_ms: int | None = None) -> DataFrame:
    """The first row of each value (and key). Each value has a small state of its own."""
    return with_state(stream.of(stream.df, key=tuple(dict.fromkeys((*stream.key, stream.value)))), Take(1), {}, idle_ms)


def buffer(stream: Flow, n: int, idle_ms: int | None = None, name: str = "items") -> DataFrame:
    """Chunks of n values in order, as `items` of the row that ends each; a shorter last one comes once its key is idle."""
    kind = stream.df.schema[stream.value].dataType.simpleString()
    return with_state(stream, Buffer(max(int(n), 1), stream.value), {name: f"array<{kind}>"}, idle_ms)


def start_with(stream: Flow, *values) -> DataFrame:
    """Literal values before the first row of each key; `_lead` is their place, 0 for rows."""
    return with_state(stream, StartWith(values, stream.value, stream.key), {"_lead": "int"})


def windowed(stream: Flow, n: int, op: str, name: str | None = None) -> DataFrame:
    if n <= 0 or op not in ("mean", "sum", "min", "max", "variance", "std"):
        raise ValueError("a window needs a length above 0 and a known operation")
    return with_state(stream, Windowed(n, op, stream.value), {name or op: "double"})


def throttle(stream: Flow, ms: int) -> DataFrame:
    return with_state(stream, Throttle(ms), {})


def rate_limit(stream: Flow, window_ms: int, most: int) -> DataFrame:
    return with_state(stream, RateLimit(window_ms, most), {"accepted": "boolean", "rate": "double"})


def combine_latest(stream: Flow, tag: str, sources: tuple, names: tuple[str, ...]) -> DataFrame:
    """stream: the union of the sources, told apart by the column `tag`."""
    kind = stream.df.schema[stream.value].dataType.simpleString()
    return with_state(stream, Latest(sources, tag, stream.value), {n: kind for n in names})


def with_latest_from(stream: Flow, tag: str, main: str, others: tuple, names: tuple[str, ...]) -> DataFrame:
    """stream: the union of the sources, told apart by the column `tag`. names: for the main value, then the others'."""
    kind = stream.df.schema[stream.value].dataType.simpleString()
    return with_state(stream, Latest((main, *others), tag, stream.value, main), {n: kind for n in names})


def debounce(stream: Flow, ms: int) -> DataFrame:
    """Rows without a successor in their key within ms. The last row of a key comes when the watermark has passed it by ms.

    The flow's time column needs a watermark.
    """
    return with_state(stream, Debounce(ms), {}, idle_ms=ms)


# ---------------------------------------------------------------- without own state


def buffer_time(stream: DataFrame, time: str, ms: int, value: str, key: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """Values by tumbling windows from the epoch, in order, once the watermark has passed a window."""
    packed = F.array_sort(F.collect_list(F.struct(time, *order, F.col(value).alias("_v"))))
    return stream.groupBy(*key, F.window(time, f"{ms} milliseconds").alias("window")).agg(F.transform(packed, lambda x: x["_v"]).alias("items"))


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def distinct_within(stream: DataFrame, columns: list[str]) -> DataFrame:
    """The first row that arrives of each value, remembered as long as the watermark asks."""
    return stream.dropDuplicatesWithinWatermark(columns)
