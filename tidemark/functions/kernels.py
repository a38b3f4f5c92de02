"""Numeric kernels on vector columns (array<float> or array<double>), as higher-order functions.

The element type stays: literals are cast to it. Null vectors give null. `map_kernel` names them; for
long vectors, where copying inside an aggregate would cost the square of the length, the running kernels
have an Arrow form (`engine="arrow"`) with numpy on whole batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column


def square(a: Vector) -> Vector:
    return F.transform(a, lambda x: x * x)


def sqrt(a: Vector, kind: str = "float") -> Vector:
    """Negative elements give NaN."""
    return F.transform(a, lambda x: F.sqrt(x).cast(kind))


def normalize(a: Vector, kind: str = "float") -> Vector:
    """(x - mean) / population deviation; a constant vector gives NaN throughout."""
    n = F.size(a)
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731 (a lambda's variable is computed once, a column in it for each element)
    square = lambda x, mean: (x.cast("double") - mean) * (x.cast("double") - mean)
    spread = lambda mean: F.sqrt(F.try_divide(F.aggregate(F.transform(a, lambda x: square(x, mean)), F.lit(0.0), lambda s, x: s + x), n))
    scaled = lambda mean, std: F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double") - mean, std), F.lit(float("nan"))).cast(kind))
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return once(F.try_divide(total, n), lambda mean: once(spread(mean), lambda std: scaled(mean, std)))


def cumsum(a: Vector, kind: str = "float", engine: str = "arrow") -> Vector:
    """Prefix sums, linear by Arrow batches; the native form is quadratic in the vector's length, for short vectors."""
    if engine == "arrow":
        return _cumsum_arrow(kind)(a)
    ones = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))
    return F.when(a.isNotNull(), F.transform(ones, lambda i: F.aggregate(F.slice(a, F.lit(1), i), F.lit(0.0).cast(kind), lambda s, x: (s + x).cast(kind))))


def mul_add(a: Vector, factor: float, addend: float, kind: str = "float") -> Vector:
    m, c = F.lit(factor).cast(kind), F.lit(addend).cast(kind)
    return F.transform(a, lambda x: (x * m + c).cast(kind))


def _same_length(a: Vector, b: Vector, out: Column) -> Column:
    return F.when(F.size(a) == F.size(b), out).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors differ in length"))))


def dot(a: Vector, b: Vector, kind: str = "float") -> Column:
    """Sum of products; vectors of different lengths are an error."""
    return _same_length(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast(kind), lambda s, x: (s + x).cast(kind)))


def vector_add(a: Vector, b: Vector) -> Vector:
    """Elementwise sum; vectors of different lengths are an error."""
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: x + y))


def rolling_mean(a: Vector, n: int, kind: str = "float", engine: str = "native") -> Vector:
    """Means of n neighbours, full windows only; a vector shorter than n gives an empty one."""
    if not isinstance(n, int) or n <= 0:
        raise ValueError("a window needs a length above 0")
    if engine == "arrow":
        return _rolling_arrow(n, kind)(a)
    at = F.when(F.size(a) >= n, F.sequence(F.lit(1), F.size(a) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.when(a.isNotNull(), F.transform(at, lambda i: (F.aggregate(F.slice(a, i, F.lit(n)), F.lit(0.0), lambda s, x: s + x.cast("double")) / n).cast(kind)))


def min_max(a: Vector, kind: str = "float") -> Column:
    """struct(min, max); an empty vector gives (0, 0)."""
    zero = F.lit(0.0).cast(kind)
    return F.when(a.isNotNull(), F.struct(F.coalesce(F.array_min(a), zero).alias("min"), F.coalesce(F.array_max(a), zero).alias("max")))


def _cumsum_arrow(kind: str):
    dtype = {"float": np.float32, "double": np.float64}[kind]

    @F.pandas_udf(f"array<{kind}>")
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda v: None if v is None else np.cumsum(np.asarray(v, dtype), dtype=dtype))

    return run


def _rolling_arrow(n: int, kind: str):
    dtype = {"float": np.float32, "double": np.float64}[kind]

    def one(v):
        if v is None:
            return None
        x = np.asarray(v, np.float64)
        return np.lib.stride_tricks.sliding_window_view(x, n).mean(1).astype(dtype) if len(x) >= n else np.zeros(0, dtype)

    @F.pandas_udf(f"array<{kind}>")
    def run(a: pd.Series) -> pd.Series:
        return a.map(one)

    return run


KERNELS: dict[str, Callable[..., Column]] = {
    "square": square,
    "sqrt": sqrt,
    "normalize": normalize,
    "cumsum": cumsum,
    "mul_add": mul_add,
    "rolling_mean": rolling_mean,
    "min_max": min_max,
    "dot": dot,
    "vector_add": vector_add,
}


def map_kernel(name: str, *vectors: Vector, **params) -> Column:
    """A kernel by name; unknown names are an error."""
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}; known: {', '.join(sorted(KERNELS))}")
    return KERNELS[name](*vectors, **params)
