"""The corpus queries that have SQL, against DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from tidemark.llm import registry

from .util import SF


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    rel = con.sql(registry.oracles()[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())


def test_one_query_of_each_operator():
    numbers = [int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 11))
