"""Flow control: credits, adaptive rates, rate limits. Controllers for a driver, and the same as queries.

The controllers guard what a driver admits (how many files or offsets a trigger takes, whether a request
is let in). As queries, calls or measurements are rows in order, and the answers become columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from time import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .flow import Flow
from .operators.folds import AdaptiveRate, Credits, RateLimit, Step, fold

MOST_CREDITS = (1 << 53) - 1


class CreditController:
    """Credits that are taken if there are enough, and given back."""

    def __init__(self, initial: int):
        self._rules = Credits(initial, MOST_CREDITS)
        self._left = initial

    def _call(self, op: str, amount: int = 0):
        self._left, (ok, _) = self._rules.step(self._left, {"op": op, "amount": amount})
        return ok

    def consume(self, amount: int) -> bool:
        return self._call("take", amount)

    def add(self, amount: int) -> None:
        self._call("add", amount)

    def reset(self) -> None:
        self._call("reset")

    @property
    def available(self) -> int:
        return self._left

    @property
    def exhausted(self) -> bool:
        return self._left == 0


class StreamCredits:
    """Credits of several streams. Unknown streams have none: nothing is taken, and they count as exhausted."""

    def __init__(self, default: int):
        self._default, self._streams = default, {}

    def register(self, stream: str, initial: int | None = None) -> None:
        self._streams[stream] = CreditController(self._default if initial is None else initial)

    def unregister(self, stream: str) -> None:
        self._streams.pop(stream, None)

    def consume(self, stream: str, amount: int) -> bool:
        return stream in self._streams and self._streams[stream].consume(amount)

    def add(self, stream: str, amount: int) -> None:
        if stream in self._streams:
            self._streams[stream].add(amount)

    def available(self, stream: str) -> int | None:
        return self._streams[stream].available if stream in self._streams else None

    def exhausted(self, stream: str) -> bool:
        return stream not in self._streams or self._streams[stream].exhausted

    def streams(self) -> list[str]:
        return list(self._streams)

    def total(self) -> int:
        return sum(c.available for c in self._streams.values())


class AdaptiveBackpressure:
    """A rate that follows latency towards a target."""

    def __init__(self, initial: float, target_ms: float, low: float, high: float):
        self._rules = AdaptiveRate(initial, target_ms, low, high)
        self.rate = float(initial)

    def update(self, latency_ms: float) -> None:
        self.rate = self._rules.update(self.rate, latency_ms)

    def set_alpha(self, alpha: float) -> None:
        self._rules.alpha = max(0.0, min(1.0, alpha))

    @property
    def delay_ms(self) -> int:
        return int(1000 // self.rate) if self.rate > 0 else MOST_CREDITS

    def should_throttle(self, throughput: float) -> bool:
        return throughput > self.rate


class WindowedRateLimiter:
    """At most so many accepted events in any window (t - window, t]."""

    def __init__(self, window_ms: int, most: int, clock: Callable[[], float] = lambda: time() * 1000):
        self._rules, self._accepted, self._clock = RateLimit(window_ms, most), [], clock

    def try_acquire(self, at_ms: float | None = None) -> bool:
        self._accepted, (ok, _) = self._rules.step(self._accepted, {"_ms": self._clock() if at_ms is None else at_ms})
        return ok

    def _recent(self, at_ms: float | None) -> int:
        now = self._clock() if at_ms is None else at_ms
        return sum(t > now - self._rules.window_ms for t in self._accepted)

    def rate(self, at_ms: float | None = None) -> float:
        return self._recent(at_ms) * 1000 / self._rules.window_ms

    def slots(self, at_ms: float | None = None) -> int:
        return max(0, self._rules.most - self._recent(at_ms))

    def reset(self) -> None:
        self._accepted = []


@dataclass
class Metrics:
    queue_size: int = 0
    processing_rate: float = 0.0
    input_rate: float = 0.0
    latency_ms: float = 0.0
    memory_usage: float = 0.0


@dataclass
class DynamicBackpressure:
    """Rejects on a full queue, on twice the target latency, or on more input than the adaptive rate."""

    max_queue: int
    target_ms: float
    adaptive: AdaptiveBackpressure = field(init=False)

    def __post_init__(self):
        self.adaptive = AdaptiveBackpressure(100, self.target_ms, 10, 1000)

    def should_accept(self, m: Metrics) -> bool:
        return m.queue_size < self.max_queue and m.latency_ms <= 2 * self.target_ms and not self.adaptive.should_throttle(m.input_rate)

    def settle(self, m: Metrics) -> None:
        """To be called after each decision, whichever it was."""
        self.adaptive.update(m.latency_ms)


class RateListener(StreamingQueryListener):
    """Feeds each micro-batch's duration and rates of a streaming query into a controller."""

    def __init__(self, control: DynamicBackpressure):
        self.control, self.last = control, Metrics()

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.last = Metrics(0, p.processedRowsPerSecond or 0.0, p.inputRowsPerSecond or 0.0, float(p.batchDuration or 0))
        self.control.settle(self.last)

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass


# ---------------------------------------------------------------- as queries


def credit_calls(flow: Flow, initial: int) -> Flow:
    """Rows (op, amount) in order -> granted (null but for take) and left."""
    return flow.of(fold(flow, Credits(initial), {"granted": "boolean", "left": "long"}))


def adaptive_rates(flow: Flow, initial: float, target_ms: float, low: float, high: float, alpha: float = 0.2) -> Flow:
    """Latencies (the value column) in order -> rate and delay_ms after each."""
    return flow.of(fold(flow, AdaptiveRate(initial, target_ms, low, high, alpha, flow.value), {"rate": "double", "delay_ms": "long"}))


@dataclass
class _Dynamic(Step):
    max_queue: int
    target_ms: float
    queue: str
    rate: str
    latency: str

    def reads(self):
        return self.queue, self.rate, self.latency

    def init(self):
        return 100.0

    def step(self, rate, row):
        ok = row[self.queue] < self.max_queue and row[self.latency] <= 2 * self.target_ms and row[self.rate] <= rate
        after = AdaptiveRate(100, self.target_ms, 10, 1000).update(rate, row[self.latency])
        return after, (ok, after)


def dynamic_decisions(flow: Flow, max_queue: int, target_ms: float, queue: str = "queue_size", rate: str = "input_rate", latency: str = "latency_ms") -> Flow:
    """Metrics in order -> accepted and the rate after each decision."""
    return flow.of(fold(flow, _Dynamic(max_queue, target_ms, queue, rate, latency), {"accepted": "boolean", "rate_after": "double"}))


def accepts(max_queue: int, target_ms: float, rate: Column | float, queue: Column, latency: Column, input_rate: Column) -> Column:
    """The decision at a fixed rate, as an expression."""
    limit = rate if isinstance(rate, Column) else F.lit(rate)
    return (queue < max_queue) & (latency <= 2 * target_ms) & (input_rate <= limit)


def within_rate(df: DataFrame, rate: float, input_rate: str = "input_rate") -> DataFrame:
    return df.filter(F.col(input_rate) <= rate)
