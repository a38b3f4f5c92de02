"""All queries over the test tables by name, with the DuckDB SQL each is held against."""

from __future__ import annotations

from . import flows, served, streams, timed, vectors
from .flows import flagship
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["flagship", "flows", "oracles", "queries", "served", "streams", "timed", "vectors"]
