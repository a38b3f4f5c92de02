"""Queries of the numeric kernels over the embeddings table. Results are folded into rounded numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels
from .registry import query, table


def _total(a):
    return F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), 3)


def _kernel(name: str, sql: str, fn) -> None:
    """Each result vector counts with its length, sum and last element."""

    @query(
        f"kernel_{name}",
        f"""SELECT vec_id, CAST(len(r) AS BIGINT) AS n, round(coalesce(list_sum(list_transform(r, lambda x: x::DOUBLE)), 0), 3) AS total, round(r[len(r)]::DOUBLE, 3) AS last FROM (SELECT vec_id, {sql} AS r FROM embeddings)""",
    )
    def run(spark, sf):
        r = F.col("r")
        return table(spark, sf, "embeddings").select("vec_id", fn(F.col("embedding")).alias("r")).select("vec_id", F.size(r).cast("long").alias("n"), _total(r).alias("total"), F.round(F.try_element_at(r, F.lit(-1)).cast("double"), 3).alias("last"))


_D = "list_transform(embedding, lambda x: x::DOUBLE)"
_kernel("square", "list_transform(embedding, lambda x: x * x)", lambda a: kernels.map_kernel("square", a))
_kernel("sqrt", "list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN sqrt(x) ELSE 0 END)", lambda a: kernels.map_kernel("sqrt", F.transform(a, lambda x: F.greatest(x, F.lit(0.0).cast("float")))))
_kernel("mul_add", "list_transform(embedding, lambda x: x * 2::FLOAT + 1.5::FLOAT)", lambda a: kernels.map_kernel("mul_add", a, factor=2, addend=1.5))
_kernel("cumsum", f"list_transform(range(1, len(embedding) + 1), lambda i: list_sum({_D}[1:i]))", lambda a: kernels.map_kernel("cumsum", a.cast("array<double>"), kind="double"))
_kernel("normalize", f"list_transform({_D}, lambda x: (x - list_avg({_D})) / list_stddev_pop({_D}))", lambda a: kernels.map_kernel("normalize", a))
_kernel("rolling_mean", "list_transform(range(4, len(embedding) + 1), lambda i: list_avg(embedding[i-3:i]))", lambda a: kernels.map_kernel("rolling_mean", a, n=4))
_kernel("vector_add", "list_transform(embedding, lambda x, i: x + embedding[len(embedding) + 1 - i])", lambda a: kernels.map_kernel("vector_add", a, F.reverse(a)))


@query("kernel_dot", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * embedding[len(embedding) + 1 - i])), 4) AS dot FROM embeddings")
def dot(spark, sf):
    a = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", F.round(kernels.map_kernel("dot", a, F.reverse(a), kind="double"), 4).alias("dot"))


@query("kernel_min_max", "SELECT vec_id, list_min(embedding) AS lo, list_max(embedding) AS hi FROM embeddings")
def min_max(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", kernels.map_kernel("min_max", F.col("embedding")).alias("m")).select("vec_id", F.col("m.min").alias("lo"), F.col("m.max").alias("hi"))
