"""Steps of inherently sequential operators, and their execution over a whole table.

A Step says what one row does to a state. The same steps run here over bounded tables and in
`tidemark.streaming` over unbounded ones. In batch, rows are dealt out by key and sorted within their
partition; Arrow batches stream through and only the state of the current key is held, so no group is
ever materialised. Steps that start anew after a gap in time (`resets_after_ms`) look at times only, and need no key to
run in parallel: the order is cut into segments, one task skims the bare times for the state that each segment begins
with (`skim` passes over rows that change nothing), and the segments are folded side by side.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..flow import Flow
from ..ordering import SEGMENTS, is_wide, lane, running, with_segment


class Step:
    """init() -> state; step(state, row) -> (state, values to add to the row, or None to drop the row)."""

    #: A gap of so many milliseconds before a row brings the state back to its start, or None.
    resets_after_ms: int | None = None

    def reads(self) -> tuple[str, ...] | None:
        """The columns that step() looks at; None for all of them."""
        return None

    def init(self) -> Any:
        return None

    def step(self, state: Any, row: dict) -> tuple[Any, tuple | None]:
        raise NotImplementedError

    def skim(self, state: Any, times: np.ndarray) -> Any:
        """The state after rows of these milliseconds, which never fall; of a step that reads nothing else."""
        for t in times.tolist():
            state, _ = self.step(state, {"_ms": t})
        return state


@dataclass
class Scan(Step):
    fn: Callable[[Any, Any], Any]
    seed: Any
    value: str

    def reads(self):
        return (self.value,)

    def init(self):
        return self.seed

    def step(self, state, row):
        state = self.fn(state, row[self.value])
        return state, (state,)


@dataclass
class Throttle(Step):
    """Leading edge: a row passes if `ms` have gone by since the last one that passed."""

    ms: int

    def __post_init__(self):
        self.resets_after_ms = self.ms

    def reads(self):
        return ("_ms",)

    def step(self, last, row):
        now = row["_ms"]
        if last is None or now - last >= self.ms:
            return now, ()
        return last, None

    def skim(self, last, times):
        if self.ms == 0:
            return int(times[-1]) if len(times) else last
        at = 0 if last is None else np.searchsorted(times, last + self.ms)
        while at < len(times):
            last = int(times[at])
            at = np.searchsorted(times, last + self.ms)
        return last


@dataclass
class RateLimit(Step):
    """Marks each row as accepted if fewer than `most` rows were accepted in (t - window, t]."""

    window_ms: int
    most: int

    def __post_init__(self):
        self.resets_after_ms = self.window_ms

    def reads(self):
        return ("_ms",)

    def init(self):
        return []

    def step(self, accepted, row):
        now = row["_ms"]
        accepted = [t for t in accepted if t > now - self.window_ms]
        ok = len(accepted) < self.most
        if ok:
            accepted.append(now)
        return accepted, (ok, len(accepted) * 1000 / self.window_ms)

    def skim(self, accepted, times):
        at = 0
        while at < len(times):
            now = int(times[at])
            accepted = [t for t in accepted if t > now - self.window_ms]
            if len(accepted) < self.most:
                accepted.append(now)
                at += 1
            elif accepted:
                at = np.searchsorted(times, accepted[0] + self.window_ms)
            else:
                break
        return accepted


@dataclass
class Credits(Step):
    """Credit calls in order. op: take, add, reset; a stream's first call finds `initial` credits."""

    initial: int
    most: int = (1 << 53) - 1

    def reads(self):
        return "op", "amount"

    def init(self):
        return self.initial

    def step(self, left, row):
        op, amount = row["op"], row["amount"] or 0
        ok = None
        if op == "take":
            ok = left >= amount
            left -= amount if ok else 0
        elif op == "add":
            left = min(left + amount, self.most)
        elif op == "reset":
            left = self.initial
        return left, (ok, left)


@dataclass
class AdaptiveRate(Step):
    """A rate that rises while the latency is below the target and falls while it is above."""

    initial: float
    target_ms: float
    low: float
    high: float
    alpha: float = 0.2
    latency: str = "latency_ms"

    def reads(self):
        return (self.latency,)

    def init(self):
        return float(self.initial)

    def update(self, rate: float, latency: float) -> float:
        return max(self.low, min(self.high, rate * (1 + self.alpha * (self.target_ms - latency) / self.target_ms)))

    def step(self, rate, row):
        rate = self.update(rate, row[self.latency])
        return rate, (rate, int(1000 // rate) if rate > 0 else (1 << 53) - 1)


def with_millis(flow: Flow) -> DataFrame:
    if not flow.time:
        raise ValueError("this operator needs the flow's time column")
    kind = flow.df.schema[flow.time].dataType
    t = F.col(flow.time)
    ms = F.floor(F.unix_micros(t.cast("timestamp")) / 1000) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else t
    return flow.df.withColumn("_ms", ms.cast("long"))


def _sliced(flow: Flow, df: DataFrame, gap: int) -> tuple[DataFrame, list[str]]:
    """A keyless flow cut where the state starts anew anyway: slices of whole sessions."""
    on = lane(df, flow.order, before=1, wide=flow.wide)
    fresh = on.df.withColumn("_new", F.coalesce((F.col("_ms") - F.lag("_ms").over(on.window()) >= gap).cast("long"), F.lit(1)))
    marked = on.close(fresh).drop("_rn")
    numbered = running(marked, flow.order, {"_session": ("sum", F.col("_new"))}, wide=flow.wide)
    return numbered.withColumn("_slice", F.pmod(F.xxhash64("_session"), F.lit(4 * SEGMENTS))), ["_slice", "_session"]


def _cut(flow: Flow, df: DataFrame, step: Step) -> tuple[DataFrame, dict[int, bytes]]:
    """A keyless flow in order of time, in segments of its order, and the state that each begins with (at most SEGMENTS)."""
    cut = with_segment(df, flow.order)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def whole() -> pa.RecordBatch:
            times = np.concatenate(held)
            return pa.RecordBatch.from_pydict({"_seg": pa.array([at], pa.int32()), "t": pa.array([zlib.compress(np.diff(times, prepend=0).tobytes(), 1)], pa.binary())})

        for batch in batches:
            segs, times = batch["_seg"].to_numpy(), batch["_ms"].to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(segs)) + 1).tolist(), len(segs)]
            for lo, hi in zip(bounds, bounds[1:]):
                if hi > lo and at is not None and segs[lo] != at:
                    yield whole()
                    held = []
                if hi > lo:
                    at = int(segs[lo])
                    held.append(times[lo:hi])
        if held:
            yield whole()

    def skimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = step.init()
        for batch in batches:
            for seg, blob in zip(batch["_seg"].to_pylist(), batch["t"]):
                yield pa.RecordBatch.from_pydict({"_seg": pa.array([seg], pa.int32()), "state": pa.array([pickle.dumps(state)], pa.binary())})
                state = step.skim(state, np.cumsum(np.frombuffer(zlib.decompress(blob.as_py()), np.int64)))

    times = cut.select("_seg", "_ms").dropna().repartition("_seg").sortWithinPartitions("_seg", "_ms").mapInArrow(packed, "_seg int, t binary")
    states = times.repartition(1).sortWithinPartitions("_seg").mapInArrow(skimmed, "_seg int, state binary")
    return cut, {r["_seg"]: bytes(r["state"]) for r in states.collect()}


def fold(flow: Flow, step: Step, added: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """flow's rows with the step's values added (DDL types in `added`), in one shuffle by key."""
    df = with_millis(flow) if flow.time else flow.df
    by, begun = list(flow.key), {}
    if not by and step.resets_after_ms is not None:
        if step.reads() != ("_ms",) or flow.order[0] != flow.time:
            df, by = _sliced(flow, df, step.resets_after_ms)
        elif is_wide(df, flow.order) if flow.wide is None else flow.wide:
            (df, begun), by = _cut(flow, df, step), ["_seg"]
    timed = step.resets_after_ms is not None
    dealt = df.repartition(by[0] if by[0] in ("_slice", "_seg") and not flow.key else F.struct(*by)) if by else df.coalesce(1)
    dealt = dealt.sortWithinPartitions(*by, *flow.order)
    own = keep or flow.df.columns
    out = T.StructType([*[f for f in flow.df.schema.fields if f.name in own and f.name not in added], *T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in added.items())).fields])
    passing = [f.name for f in out.fields if f.name not in added]
    needed = list(dict.fromkeys([*by, *(step.reads() or df.columns)]))  # only these become Python values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, first, lone = None, None, True, False
        for batch in batches:
            rows = batch.select(needed).to_pylist()
            picked: list[int] = []
            made: list[list] = [[] for _ in added]
            for k, row in enumerate(rows):
                key = [row[c] for c in by]
                if first or key != at:
                    at, state, first = key, pickle.loads(begun[key[0]]) if begun and key[0] in begun else step.init(), False
                elif timed and (lone or row["_ms"] is None):  # no time, no gap: it stands alone
                    state = step.init()
                lone = timed and row["_ms"] is None
                state, got = step.step(state, row)
                if got is not None:
                    picked.append(k)
                    for column, value in zip(made, got, strict=True):
                        column.append(value)
            kept = batch.select(passing).take(pa.array(picked, pa.int64()))
            from pyspark.sql.pandas.types import to_arrow_type

            extra = [pa.array(column, to_arrow_type(out[name].dataType)) for name, column in zip(added, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *extra], names=[*passing, *added])

    return dealt.mapInArrow(run, out)
