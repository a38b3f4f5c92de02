"""Every query of the catalogue against DuckDB on the smallest tables; other libraries' queries are tested beside them."""

import math
from collections import Counter

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES + ["conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 and isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.select(*names).collect())
    rel = duck.sql(catalog.oracles()[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_admission_by_hand(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect()
    got = {r["event_id"]: r["accepted"] for r in catalog.queries()["queue_admission"](spark, SF).collect()}
    accepted: list = []
    for r in rows:
        now = r["ts"].timestamp() * 1000 // 1
        accepted = [t for t in accepted if t > now - 900_000]
        assert got[r["event_id"]] == (len(accepted) < 2)
        if len(accepted) < 2:
            accepted.append(now)


def test_streams_end_as_their_batch_forms_do(spark):
    for stream, batch in (("stream_debounce", "debounce"), ("stream_throttle", "throttle")):
        assert sorted(catalog.queries()[stream](spark, SF).collect()) == sorted(catalog.queries()[batch](spark, SF).collect())


def test_no_query_of_the_library_is_without_sql():
    assert set(catalog.oracles()) == set(catalog.queries())


def test_ticks_count_from_zero(spark):
    got = sorted(r[0] for r in catalog.queries()["stream_interval"](spark, SF).collect())
    assert got == list(range(50))
