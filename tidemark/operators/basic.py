"""Projection, filtering, limits, prefixes and forks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..flow import Expr, Flow
from ..ordering import ranked


def _count(n: int, what: str) -> int:
    if not isinstance(n, int) or n < 0:
        raise ValueError(f"{what} must be a whole number from 0")
    return n


def map_values(flow: Flow, expr: Expr, drop_null: bool = False, name: str | None = None) -> Flow:
    """One value for each row. A null stays unless drop_null asks for the "no element" reading."""
    out = flow.df.withColumn(name or flow.value, flow.column(expr))
    if drop_null:
        out = out.filter(F.col(name or flow.value).isNotNull())
    return flow.of(out, value=name or flow.value)


def filter_rows(flow: Flow, pred: Expr) -> Flow:
    """Rows for which the predicate holds; null counts as false."""
    return flow.of(flow.df.filter(flow.column(pred)))


def take(flow: Flow, n: int) -> Flow:
    """The first n rows (of each key)."""
    _count(n, "take")
    if not flow.key:
        return flow.of(flow.df.orderBy(*flow.order).limit(n))
    w = W.partitionBy(*flow.key).orderBy(*flow.order)
    return flow.of(flow.df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn"))


def skip(flow: Flow, n: int) -> Flow:
    """All but the first n rows (of each key)."""
    _count(n, "skip")
    if not n:
        return flow
    return flow.of(ranked(flow.df, flow.order, flow.key, wide=flow.wide).filter(F.col("_rn") > n).drop("_rn"))


def start_with(flow: Flow, *values) -> Flow:
    """Literal values before the first row (of each key). Adds the order column `_lead`: their place, 0 for rows."""
    lead = len(values)
    body = flow.df.withColumn("_lead", F.lit(0))
    if not values:
        return flow.of(body, order=("_lead", *flow.order))
    kind = flow.df.schema[flow.value].dataType
    items = F.array(*[F.struct(F.lit(k - lead).alias("_lead"), F.lit(v).cast(kind).alias(flow.value)) for k, v in enumerate(values)])
    keys = flow.df.select(*flow.key).distinct() if flow.key else flow.df.sparkSession.range(1).select()
    head = keys.select(*flow.key, F.explode(items).alias("_item")).select(*flow.key, "_item._lead", f"_item.{flow.value}")
    return flow.of(body.unionByName(head, allowMissingColumns=True), order=("_lead", *flow.order))


def fork(flow: Flow, pred: Expr) -> tuple[Flow, Flow]:
    """Rows that satisfy the predicate, and all others; a null predicate goes with the others."""
    yes = F.coalesce(flow.column(pred).cast("boolean"), F.lit(False))
    return flow.of(flow.df.filter(yes)), flow.of(flow.df.filter(~yes))


def select(flow: Flow, *columns: str | Column) -> DataFrame:
    return flow.df.select(*columns)
