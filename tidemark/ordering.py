"""Order made distributed: ranks, blocks with neighbours, and running values over a whole table.

A window without a partition key puts all rows into one task. The helpers here give the same results
for a flow without a key by cutting its order into segments:

1. a sample of order tuples gives at most SEGMENTS - 1 bounds, and a row finds its segment among them by bisection;
2. rows are counted by segment; summing those few counts gives each segment its first rank;
3. ranks cut the rows into blocks of an exact length, and rows near a border are also handed to the
   neighbouring block (a halo), so that lag, lead and sliding frames are local to a block.

Running aggregates are local to a segment plus the value brought in from the segments before it. The
bounds and the table of segments have at most SEGMENTS rows, which is what is collected or broadcast.
The bounds take in all order columns, strings too, so ties in the first one are cut as well; rows that tie in
all order columns have no order and stay in one segment.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

SEGMENTS = 256
BLOCK = 1 << 20
#: Estimated bytes of a table from which order without a key is cut into segments.
WIDE_BYTES = 16 << 20

#: Bytes of order tuples that the bounds are taken from, and how many of those for each segment.
SAMPLE_BYTES, SAMPLED = 64 << 20, 64

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_CUTTABLE = (*_NUMBERS, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_wide(df: DataFrame, order: Sequence[str]) -> bool:
    """Whether a keyless order over df is worth cutting, and can be."""
    return isinstance(df.schema[order[0]].dataType, _CUTTABLE) and estimated_bytes(df) > WIDE_BYTES


def _measure(df: DataFrame, name: str) -> Column:
    """An order column as something that a literal can be compared with."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    return F.datediff(c, F.lit("1970-01-01")) if isinstance(kind, T.DateType) else c


def with_segment(df: DataFrame, order: Sequence[str], segments: int = SEGMENTS, name: str = "_seg") -> DataFrame:
    """Adds a number that never falls along the order. Nulls come first, as they sort."""
    cut = list(takewhile(lambda c: isinstance(df.schema[c].dataType, _CUTTABLE), order))
    at = [_measure(df, c) for c in cut]
    tuples = df.select(*[c.alias(f"m{k}") for k, c in enumerate(at)])
    size = estimated_bytes(tuples)
    if size >= 1 << 60:  # not known to Spark
        size = 32 * tuples.count()
    share = min(1.0, SAMPLE_BYTES / max(size, 1))
    some = tuples.sample(share, seed=1) if share < 1 else tuples
    some = some.dropna().orderBy(F.xxhash64(*tuples.columns)).limit(segments * SAMPLED)  # what is collected
    found = sorted(tuple(r) for r in some.collect()) if cut else []
    bounds = sorted({found[len(found) * k // segments] for k in range(1, segments)}) if found else []
    if not bounds:
        return df.withColumn(name, F.lit(0))
    lists = [F.array(*[F.lit(b[k]) for b in bounds]) for k in range(len(cut))]

    def above(place: Column) -> Column:
        """Whether the row's tuple is above the bound there."""
        out = F.lit(False)
        for values, mine in reversed(list(zip(lists, at, strict=True))):
            bound = F.get(values, place)
            out = (mine > bound) | ((mine == bound) & out)
        return F.coalesce(out, F.lit(False))

    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    seg = F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), lambda n, step: n + F.when((n + step <= len(bounds)) & above(n + step - 1), step).otherwise(0))
    return df.withColumn(name, F.when(F.col(f"`{cut[0]}`").isNull(), F.lit(0)).otherwise(seg))


def ranked(df: DataFrame, order: Sequence[str], key: Sequence[str] = (), name: str = "_rn", wide: bool | None = None) -> DataFrame:
    """Adds the 1-based position along the order (within the key) as a long."""
    if key or not (is_wide(df, order) if wide is None else wide):
        return df.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order)).cast("long"))
    cut = with_segment(df, order)
    counts = cut.groupBy("_seg").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = cut.withColumn("_local", F.row_number().over(W.partitionBy("_seg").orderBy(*order)))
    joined = local.join(F.broadcast(starts), "_seg")  # at most SEGMENTS rows
    return joined.withColumn(name, F.col("_local") + F.col("_before")).drop("_seg", "_local", "_before")


@dataclass
class Lane:
    """A frame in which windows over `window()` see the neighbours they need; `close` takes helpers out."""

    df: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    helpers: tuple[str, ...] = ()

    def window(self) -> WindowSpec:
        return W.partitionBy(*self.by).orderBy(*self.order)

    def close(self, df: DataFrame) -> DataFrame:
        return df.filter(~F.col("_halo")).drop(*self.helpers) if self.helpers else df


def lane(df: DataFrame, order: Sequence[str], key: Sequence[str] = (), before: int = 0, after: int = 0, wide: bool | None = None, block: int = BLOCK) -> Lane:
    """Lanes for windows that look at most `before` rows back and `after` rows ahead.

    Has the column `_rn` (position from 1) in either form.
    """
    if key or not (is_wide(df, order) if wide is None else wide):
        return Lane(ranked(df, order, key, wide=False), tuple(key), tuple(order))
    size = max(block, before, after, 1)
    numbered = ranked(df, order, wide=True)
    at, inside = F.floor((F.col("_rn") - 1) / size).cast("long"), (F.col("_rn") - 1) % size
    copies = [F.struct(at.alias("b"), F.lit(False).alias("h"))]
    if before:
        copies.append(F.when(inside >= size - before, F.struct((at + 1).alias("b"), F.lit(True).alias("h"))))
    if after:
        copies.append(F.when((inside < after) & (at > 0), F.struct((at - 1).alias("b"), F.lit(True).alias("h"))))
    spread = numbered.withColumn("_copy", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
    spread = spread.withColumn("_block", F.col("_copy.b")).withColumn("_halo", F.col("_copy.h")).drop("_copy")
    return Lane(spread, ("_block",), tuple(order), ("_block", "_halo"))


RUNNING = ("sum", "count", "min", "max", "last")


def _running(kind: str, value: Column) -> Column:
    """An aggregate that can be continued: its value over later rows combines with the one brought in."""
    return {"sum": lambda: F.sum(value), "count": lambda: F.count(value), "min": lambda: F.min(value), "max": lambda: F.max(value), "last": lambda: F.last(value, ignorenulls=True)}[kind]()


def _combine(kind: str, brought: Column, own: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(brought.isNull(), own).when(own.isNull(), brought).otherwise(brought + own)
    if kind in ("min", "max"):
        return (F.least if kind == "min" else F.greatest)(brought, own)
    return F.coalesce(own, brought)


def running(df: DataFrame, order: Sequence[str], outputs: dict[str, tuple[str, Column]], key: Sequence[str] = (), wide: bool | None = None) -> DataFrame:
    """Adds running aggregates from the first row to the current one: name -> (one of RUNNING, column)."""
    if bad := [k for k, _ in outputs.values() if k not in RUNNING]:
        raise ValueError(f"unknown running aggregates: {bad}")
    up = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    if key or not (is_wide(df, order) if wide is None else wide):
        w = up(W.partitionBy(*key).orderBy(*order))
        return df.select("*", *[_running(kind, value).over(w).alias(name) for name, (kind, value) in outputs.items()])
    names = {name: f"_v{k}" for k, name in enumerate(outputs)}
    cut = with_segment(df.select("*", *[outputs[name][1].alias(v) for name, v in names.items()]), order)
    lasts = lambda v: F.max_by(F.struct(F.col(v)), F.when(F.col(v).isNotNull(), F.struct(*order))).getField(v)
    parts = cut.groupBy("_seg").agg(*[(lasts(v) if outputs[name][0] == "last" else _running(outputs[name][0], F.col(v))).alias(v) for name, v in names.items()])
    before = W.orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    redo = {"count": "sum"}
    brought = parts.select("_seg", *[_running(redo.get(outputs[name][0], outputs[name][0]), F.col(v)).over(before).alias(f"{v}b") for name, v in names.items()])
    w = up(W.partitionBy("_seg").orderBy(*order))
    local = cut.select("*", *[_running(outputs[name][0], F.col(v)).over(w).alias(f"{v}o") for name, v in names.items()])
    joined = local.join(F.broadcast(brought), "_seg")  # at most SEGMENTS rows
    own = [c for c in df.columns]
    return joined.select(*own, *[_combine(outputs[name][0], F.col(f"{v}b"), F.col(f"{v}o")).alias(name) for name, v in names.items()])
