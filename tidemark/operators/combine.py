"""Several flows as one: merge, combine by position, latest values; and ordered flattening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..flow import Expr, Flow
from ..ordering import lane, ranked, running


def merge(flow: Flow, *others: Flow) -> Flow:
    """All rows of all flows (columns by name, missing ones null), in the order of the first flow's columns."""
    return flow.of(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [flow.df, *[o.df for o in others]]))


def combine(*flows: Flow, names: tuple[str, ...] | None = None) -> Flow:
    """Values side by side by position; a flow that has ended repeats its last value; an empty one empties all.

    Each flow is ranked once and joined on the position. The ends of the flows are one row.
    """
    if not flows:
        raise ValueError("combine needs a flow")
    if any(f.key for f in flows):
        raise ValueError("combine takes flows without keys")
    names = names or tuple(f"v{k}" for k in range(len(flows)))
    sides = [ranked(f.df.select(*dict.fromkeys(f.order), F.col(f.value).alias("_value")), f.order, wide=f.wide).select("_rn", F.col("_value").alias(n)) for f, n in zip(flows, names, strict=True)]
    ends = reduce(lambda a, b: a.crossJoin(b), [F.broadcast(s.agg(F.count(F.lit(1)).alias(f"_n{k}"), F.max_by(F.struct(n), "_rn").alias(f"_l{k}"))) for k, (s, n) in enumerate(zip(sides, names, strict=True))])  # one row each
    joined = reduce(lambda a, b: a.join(b, "_rn", "full"), sides)
    out = joined.crossJoin(F.broadcast(ends)).filter(reduce(lambda a, b: a & b, [F.col(f"_n{k}") > 0 for k in range(len(flows))]))
    picked = [F.when(F.col("_rn") <= F.col(f"_n{k}"), F.col(n)).otherwise(F.col(f"_l{k}").getField(n)).alias(n) for k, n in enumerate(names)]
    return flows[0].of(out.select(F.col("_rn").alias("pos"), *picked), order=("pos",), time=None, value=names[0])


def _tagged(flows: tuple[Flow, ...], names: tuple[str, ...]) -> DataFrame:
    """All rows as (time, source number, first flow's key and last order column, value of each source)."""
    parts = []
    for k, f in enumerate(flows):
        if not f.time:
            raise ValueError("latest values need time columns")
        values = [(F.struct(F.col(f.value).alias("v")) if j == k else F.lit(None).cast(f"struct<v:{g.df.schema[g.value].dataType.simpleString()}>")).alias(f"_s{j}") for j, g in enumerate(flows)]
        parts.append(f.df.select(*[F.col(a).alias(b) for a, b in zip(f.key, flows[0].key, strict=True)], F.col(f.time).alias("time"), F.lit(k).alias("src"), F.col(f.order[-1]).alias("id"), *values))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _latest(flows: tuple[Flow, ...], names: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """Values travel in structs, so that a null value counts as seen."""
    rows = _tagged(flows, names)
    seen = running(rows, ("time", "src", "id"), {f"_l{k}": ("last", F.col(f"_s{k}")) for k in range(len(flows))}, flows[0].key, flows[0].wide)
    every = reduce(lambda a, b: a & b, [F.col(f"_l{k}").isNotNull() for k in range(len(flows))])
    return seen, every


def combine_latest(*flows: Flow, names: tuple[str, ...] | None = None) -> Flow:
    """For each row, once all flows have had one: the latest value of each. At one time flows go in their order."""
    names = names or tuple(f"v{k}" for k in range(len(flows)))
    seen, every = _latest(flows, names)
    out = seen.filter(every).select(*flows[0].key, "time", "src", "id", *[F.col(f"_l{k}.v").alias(n) for k, n in enumerate(names)])
    return flows[0].of(out, order=("time", "src", "id"), time="time", value=names[0])


def with_latest_from(flow: Flow, *others: Flow, names: tuple[str, ...] | None = None) -> Flow:
    """Rows of the first flow with the latest value of each other; rows before all others have one are left out.

    At equal times the others' rows count as earlier.
    """
    names = names or ("v0", *[f"v{k + 1}" for k in range(len(others))])
    flows = (*others, flow)
    order = (*names[1:], names[0])
    seen, every = _latest(flows, order)
    out = seen.filter(every & (F.col("src") == len(others))).select(*flow.key, "time", "id", *[F.col(f"_l{k}.v").alias(n) for k, n in enumerate(order)])
    return flow.of(out.select(*flow.key, "time", "id", *names), order=("time", "id"), time="time", value=names[0])


def concat_map(flow: Flow, items: Expr, pos: str = "pos", name: str | None = None) -> Flow:
    """The elements of each row's array, in the order of rows, then of elements. Empty and null arrays give none."""
    name = name or flow.value
    rest = [c for c in flow.df.columns if c != name]
    out = flow.df.withColumn("_items", flow.column(items)).select(*rest, F.posexplode("_items").alias(pos, name))
    return flow.of(out.withColumn(pos, F.col(pos).cast("long")), order=(*flow.order, pos), value=name)


def concat_flow(outer: Flow, inner: Flow, on: list[str], pos: str = "pos") -> Flow:
    """Ordered flattening of a sub-flow for each outer row: rows of inner with equal `on` columns."""
    theirs = [c for c in inner.df.columns if c not in on]
    if clash := set(theirs) & set(outer.df.columns):
        raise ValueError(f"columns in both flows: {sorted(clash)}")
    return outer.of(outer.df.join(inner.df, on), order=(*outer.order, *[c for c in inner.order if c not in outer.order]), value=inner.value)


def switch_map(outer: Flow, inner: Flow, on: list[str]) -> Flow:
    """Like concat_flow in event time, where each outer row ends the inner flow of the one before.

    An inner row counts from its outer row's time until the next outer row's, which it must precede.
    """
    if not outer.time or not inner.time:
        raise ValueError("switch_map needs time columns on both sides")
    nxt = lane(outer.df, outer.order, outer.key, after=1, wide=outer.wide)
    timed = nxt.close(nxt.df.withColumn("_until", F.lead(outer.time).over(nxt.window()))).drop("_rn")
    theirs = inner.df.select(*on, *[F.col(c).alias(f"inner_{c}") for c in inner.df.columns if c not in on])
    t = F.col(f"inner_{inner.time}")
    out = timed.join(theirs, on).filter((t >= F.col(outer.time)) & (F.col("_until").isNull() | (t < F.col("_until")))).drop("_until")
    return outer.of(out, order=(*outer.order, *[f"inner_{c}" for c in inner.order if c not in on]), value=f"inner_{inner.value}")


def switch_items(outer: Flow, items: Expr, at_ms: str = "at_ms") -> Flow:
    """switch_map for inner rows that stand in an array of structs with an offset in milliseconds from the outer row."""
    if not outer.time:
        raise ValueError("switch_items needs a time column")
    on = lane(outer.df, outer.order, outer.key, after=1, wide=outer.wide)
    us = F.unix_micros(F.col(outer.time).cast("timestamp")) if "timestamp" in dict(outer.df.dtypes)[outer.time] else F.col(outer.time).cast("long") * 1000
    timed = on.df.withColumn("_us", us)
    timed = on.close(timed.withColumn("_left", F.lead("_us").over(on.window()) - F.col("_us"))).drop("_rn", "_us")
    out = timed.withColumn("_items", outer.column(items)).select("*", F.posexplode("_items").alias("pos", "item")).drop("_items")
    out = out.filter(F.col("_left").isNull() | (F.col(f"item.{at_ms}") * 1000 < F.col("_left"))).drop("_left").withColumn("pos", F.col("pos").cast("long"))
    return outer.of(out, order=(*outer.order, "pos"), value="item")
