"""Where flows end: ordered values on the driver, observers, files, and subscriptions to streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..flow import Flow


def iterate(flow: Flow) -> Iterator[Any]:
    """The values in order, one partition at a time on the driver."""
    for row in flow.sorted().select(flow.value).toLocalIterator(prefetchPartitions=True):
        yield row[0]


def to_array(flow: Flow) -> list:
    """All values in order, on the driver: for results that fit there."""
    return flow.sorted().select(*dict.fromkeys([*flow.key, *flow.order, flow.value])).toArrow().column(flow.value).to_pylist()


def observe(flow: Flow, on_next: Callable[[Any], None], on_error: Callable[[Exception], None] | None = None, on_complete: Callable[[], None] | None = None, terminate: bool = False) -> bool:
    """Calls on_next with each value in order; True if it came to the end.

    What on_next raises goes to on_error and the flow goes on, unless terminate is set. StopIteration from
    on_next unsubscribes: nothing more is delivered and on_complete is not called.
    """
    for value in iterate(flow):
        try:
            on_next(value)
        except StopIteration:
            return False
        except Exception as err:
            if on_error is None:
                raise
            on_error(err)
            if terminate:
                return False
    if on_complete is not None:
        on_complete()
    return True


class Subscription:
    """A running streaming query."""

    def __init__(self, query: StreamingQuery):
        self.query = query

    @property
    def is_active(self) -> bool:
        return self.query.isActive

    def unsubscribe(self) -> None:
        self.query.stop()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.unsubscribe()


def subscribe(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str | None = None, **trigger) -> Subscription:
    """Calls on_batch with each micro-batch of a stream. trigger: as of DataStreamWriter.trigger."""
    writer = stream.writeStream.foreachBatch(on_batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return Subscription((writer.trigger(**trigger) if trigger else writer).start())


def to_ndjson(flow: Flow, path: str) -> None:
    """Rows as JSON lines, ordered across the files."""
    flow.sorted().write.json(path)


def to_parquet(flow: Flow, path: str, partition_by: list[str] | None = None) -> None:
    flow.df.write.partitionBy(*(partition_by or [])).parquet(path)
