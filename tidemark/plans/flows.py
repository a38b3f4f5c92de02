"""Queries of projection, limits, combination, sequences and terminals."""

from __future__ import annotations

import asyncio
import uuid

from pyspark.sql import functions as F

from ..flow import Flow
from ..operators import combine, errors, terminals
from ..sources import bounded, sinks
from .registry import events, query, r6, shared_folder, table

BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"


@query(
    "scan",
    f"""SELECT user_id, ts, event_id, value * 2 AS doubled, round(sum(value * 2) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING), 6) AS running
    FROM events WHERE value > 50""",
)
def flagship(spark, sf):
    """Large events, doubled, with a running total by user."""
    f = events(spark, sf).filter(lambda v: v > 50).map(lambda v: v * 2, name="doubled").scan("sum", name="running")
    return f.df.select("user_id", "ts", "event_id", "doubled", r6(F.col("running")).alias("running"))


# ---------------------------------------------------------------- sources, projection, filter, limit


@query("range", "SELECT range AS ord, 3 + range * 2 AS value FROM range(49999)")
def range_query(spark, sf):
    return bounded.range_(spark, 3, 100_000, 2).df


@query("of", "SELECT * FROM (VALUES (0::BIGINT, 7::BIGINT), (1, 11), (2, 13)) t(ord, value)")
def of_query(spark, sf):
    return bounded.of(spark, 7, 11, 13).df


@query("empty", "SELECT 0::BIGINT AS ord, 0::BIGINT AS value WHERE false")
def empty_query(spark, sf):
    return bounded.empty(spark).df


@query("from_callable", "SELECT 0::BIGINT AS ord, 42::BIGINT AS value")
def from_callable(spark, sf):
    return bounded.from_callable(spark, lambda: 6 * 7, "long").df


@query("from_generator", "SELECT range AS ord, range * range AS value FROM range(1000)")
def from_generator(spark, sf):
    return bounded.from_values(spark, (k * k for k in range(1000))).df


@query("from_vector", "SELECT 0::BIGINT AS ord, CAST(pos AS BIGINT) AS pos, CAST(pos / 4 AS FLOAT) AS value FROM (SELECT unnest(range(200)) AS pos)")
def from_vector(spark, sf):
    """A typed array is one element; here it is opened."""
    f = bounded.from_vector(spark, [k / 4 for k in range(200)])
    return f.concat_map(F.col("value")).df.select("ord", F.col("pos").cast("long").alias("pos"), "value")


_NAMES = "SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS ord, n_name AS value FROM nation"


def _nations(spark, sf) -> Flow:
    return Flow(table(spark, sf, "nation"), ("n_regionkey", "n_nationkey"), value="n_name")


@query("to_array", _NAMES)
def to_array(spark, sf):
    """The ordered values of a small table on the driver, and back."""
    return bounded.from_values(spark, _nations(spark, sf).to_array()).df


@query("iterated", _NAMES)
def iterated(spark, sf):
    return bounded.from_values(spark, list(_nations(spark, sf))).df


@query("observed", _NAMES + " UNION ALL SELECT -1, 'complete'")
def observed(spark, sf):
    """What an observer is told: each value in order, then the end."""
    seen: list = []
    sinks.observe(_nations(spark, sf), seen.append, on_complete=lambda: seen.append("complete"))
    rows = [(-1 if v == "complete" else k, v) for k, v in enumerate(seen)]
    return spark.createDataFrame(rows, "ord long, value string")


@query("ndjson", "SELECT event_id, user_id, event_type, value, props FROM events")
def ndjson(spark, sf):
    """events out as JSON lines and in again."""
    at = f"{shared_folder(spark)}/ndjson-{uuid.uuid4().hex}"
    f = events(spark, sf)
    sinks.to_ndjson(f.of(f.df.select("event_id", "user_id", "event_type", "value", "props", "ts")), at)
    return bounded.from_ndjson(spark, at, "event_id long, user_id long, event_type string, value double, props string", ("event_id",)).df


class _Flaky:
    """Fails on the first two calls for a value; values that end in 5 always fail."""

    def __init__(self):
        self.calls: dict = {}

    def __call__(self, x):
        self.calls[x] = self.calls.get(x, 0) + 1
        if x % 10 == 5 or self.calls[x] < 3:
            raise ValueError("not yet")
        return x * 2


@query("errors_retry", "SELECT n_nationkey, n_nationkey * 2 AS doubled FROM nation WHERE n_nationkey % 10 <> 5")
def errors_retry(spark, sf):
    f = Flow(table(spark, sf, "nation").select("n_nationkey"), ("n_nationkey",), value="n_nationkey")
    keyed = f.of(f.df.withColumn("v", F.col("n_nationkey")), value="v")
    return errors.attempt_python(keyed, _Flaky(), "int", retries=2, name="doubled").drop().df.select("n_nationkey", "doubled")


async def _later(x):
    """Later values answer sooner."""
    await asyncio.sleep((1000 - x % 1000) / 1e6)
    if x % 97 == 0:
        raise ValueError("no answer")
    return x * 10 + 1


@query("parallel_map", "SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS squared FROM lineitem")
def parallel_map(spark, sf):
    """A Python function on the Arrow batches of all partitions at a time."""
    f = Flow(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q")), ("l_orderkey", "l_linenumber"), value="q")
    return errors.attempt_python(f, lambda q: q * q, "double", name="squared").drop().df.select("l_orderkey", "l_linenumber", "squared")


@query("map_async", "SELECT event_id, event_id * 10 + 1 AS answer FROM events WHERE event_id % 97 <> 0")
def map_async(spark, sf):
    f = events(spark, sf, value="event_id")
    thin = f.of(f.df.select("user_id", "ts", "event_id", F.col("event_id").alias("asked")), value="asked")
    return errors.attempt_async(thin, _later, "long", name="answer").drop().df.select("event_id", "answer")


@query("map_filter", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doubled FROM lineitem WHERE CAST(l_quantity * 2 AS BIGINT) % 3 = 0")
def map_filter(spark, sf):
    f = Flow(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ("l_orderkey", "l_linenumber"), value="l_quantity")
    return f.map(lambda q: q * 2, name="doubled").filter(lambda d: d.cast("long") % 3 == 0).df.select("l_orderkey", "l_linenumber", "doubled")


@query("map_drop_null", """SELECT event_id, k FROM (SELECT event_id, CASE WHEN value > 20 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events) WHERE k IS NOT NULL""")
def map_drop_null(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf).map(F.when(F.col("value") > 20, k), drop_null=True, name="k").df.select("event_id", "k")


@query("take", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000")
def take_query(spark, sf):
    return Flow(table(spark, sf, "orders"), ("o_orderdate", "o_orderkey")).take(1000).df.select("o_orderkey", "o_totalprice")


@query("take_by_key", f"SELECT user_id, event_id FROM events QUALIFY row_number() OVER ({BY_USER}) <= 3")
def take_by_key(spark, sf):
    return events(spark, sf).take(3).df.select("user_id", "event_id")


@query("skip", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 1000")
def skip_query(spark, sf):
    return Flow(table(spark, sf, "orders"), ("o_orderdate", "o_orderkey")).skip(1000).df.select("o_orderkey", "o_totalprice")


@query("skip_by_key", f"SELECT user_id, event_id FROM events QUALIFY row_number() OVER ({BY_USER}) > 3")
def skip_by_key(spark, sf):
    return events(spark, sf).skip(3).df.select("user_id", "event_id")


@query("start_with", """SELECT CAST(0 AS INTEGER) AS lead, n_nationkey, n_name FROM nation
    UNION ALL SELECT CAST(-2 AS INTEGER), NULL, 'FIRST' UNION ALL SELECT CAST(-1 AS INTEGER), NULL, 'SECOND'""")
def start_with(spark, sf):
    f = Flow(table(spark, sf, "nation"), ("n_nationkey",), value="n_name").start_with("FIRST", "SECOND")
    return f.df.select(F.col("_lead").alias("lead"), "n_nationkey", "n_name")


@query("fork_yes", "SELECT event_id, value FROM events WHERE value > 50")
def fork_yes(spark, sf):
    return events(spark, sf).fork(lambda v: v > 50)[0].df.select("event_id", "value")


@query("fork_no", "SELECT event_id, value FROM events WHERE NOT coalesce(value > 50, false)")
def fork_no(spark, sf):
    return events(spark, sf).fork(lambda v: v > 50)[1].df.select("event_id", "value")


# ---------------------------------------------------------------- combination


def of_type(f: Flow, kind: str) -> Flow:
    return f.of(f.df.filter(F.col("event_type") == kind))


@query("merge", "SELECT event_id, event_type, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, event_type, value FROM events WHERE event_type = 'view'")
def merge_query(spark, sf):
    e = events(spark, sf, keyed=False)
    return of_type(e, "click").merge(of_type(e, "view")).df.select("event_id", "event_type", "value")


@query(
    "combine",
    """WITH r AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS rn, r_name FROM region),
    n AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS rn, n_name FROM nation),
    p AS (SELECT unnest(range(1, greatest((SELECT count(*) FROM r), (SELECT count(*) FROM n)) + 1)) AS pos)
    SELECT pos, r_name, n_name FROM p JOIN r ON r.rn = least(pos, (SELECT count(*) FROM r)) JOIN n ON n.rn = least(pos, (SELECT count(*) FROM n))""",
)
def combine_query(spark, sf):
    r = Flow(table(spark, sf, "region"), ("r_regionkey",), value="r_name")
    n = Flow(table(spark, sf, "nation"), ("n_nationkey",), value="n_name")
    return combine.combine(r, n, names=("r_name", "n_name")).df


_LATEST = """WITH t AS (SELECT user_id, ts, 0 AS src, event_id, {{'v': value}} AS a, NULL AS b FROM events WHERE event_type = 'click'
    UNION ALL SELECT user_id, ts, 1, event_id, NULL, {{'v': value}} FROM events WHERE event_type = 'view'),
    l AS (SELECT *, last_value(a IGNORE NULLS) OVER w AS la, last_value(b IGNORE NULLS) OVER w AS lb FROM t
          WINDOW w AS (PARTITION BY user_id ORDER BY ts, src, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT user_id, event_id AS id, la.v AS click, lb.v AS view FROM l WHERE la IS NOT NULL AND lb IS NOT NULL {more}"""


@query("combine_latest", _LATEST.format(more=""))
def combine_latest(spark, sf):
    e = events(spark, sf)
    return combine.combine_latest(of_type(e, "click"), of_type(e, "view"), names=("click", "view")).df.select("user_id", "id", "click", "view")


@query(
    "with_latest_from",
    """SELECT p.user_id, p.event_id AS id, p.value AS purchase, v.value AS view
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v
    ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def with_latest_from(spark, sf):
    e = events(spark, sf)
    return combine.with_latest_from(of_type(e, "purchase"), of_type(e, "view"), names=("purchase", "view")).df.select("user_id", "id", "purchase", "view")


@query("concat_map", """SELECT event_id, CAST(k AS BIGINT) AS pos, event_id * 10 + k AS item FROM (SELECT event_id, unnest(range(CAST(floor(value) AS BIGINT) % 4)) AS k FROM events)""")
def concat_map(spark, sf):
    n = (F.floor("value") % 4).cast("int")
    items = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.col("event_id") * 10 + k))
    return events(spark, sf, keyed=False).concat_map(items).df.select("event_id", "pos", F.col("value").alias("item"))


@query("concat_flow", """SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def concat_flow(spark, sf):
    outer = Flow(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ("o_orderdate", "o_orderkey"))
    inner = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return combine.concat_flow(outer, Flow(inner, ("l_linenumber",), value="l_quantity"), ["o_orderkey"]).df.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(
    "switch_map",
    """SELECT o.o_custkey, o.o_orderkey, l_linenumber, l_partkey, l_suppkey FROM
    (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM orders) o
    JOIN lineitem ON l_orderkey = o.o_orderkey AND l_shipdate >= o_orderdate AND (until IS NULL OR l_shipdate < until)""",
)
def switch_map(spark, sf):
    """Shipments of a customer's order, until the customer's next order."""
    outer = Flow(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ("o_orderdate", "o_orderkey"), ("o_custkey",), "o_orderdate")
    inner = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    out = combine.switch_map(outer, Flow(inner, ("l_shipdate", "l_linenumber"), time="l_shipdate", value="l_partkey"), ["o_orderkey"])
    return out.df.select("o_custkey", "o_orderkey", F.col("inner_l_linenumber").alias("l_linenumber"), F.col("inner_l_partkey").alias("l_partkey"), F.col("inner_l_suppkey").alias("l_suppkey"))


# ---------------------------------------------------------------- sequences


@query("scan_global", "SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS running FROM events")
def scan_global(spark, sf):
    """A running total over the whole table, without a key: cut into segments, whatever the table's size."""
    f = events(spark, sf, keyed=False, wide=True).scan("sum", name="running")
    return f.df.select("event_id", F.round("running", 3).alias("running"))


@query(
    "scan_kinds",
    f"""SELECT event_id, count(value) OVER w AS n, min(value) OVER w AS lo, max(value) OVER w AS hi
    FROM events WINDOW w AS ({BY_USER} ROWS UNBOUNDED PRECEDING)""",
)
def scan_kinds(spark, sf):
    f = events(spark, sf)
    out = f.scan("count", name="n").df
    for kind, name in (("min", "lo"), ("max", "hi")):
        out = Flow(out, f.order, f.key).scan(kind, name=name).df
    return out.select("event_id", "n", "lo", "hi")


@query("scan_python", f"SELECT event_id, round(sum(value * value) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING), 4) AS energy FROM events")
def scan_python(spark, sf):
    f = events(spark, sf).scan(lambda s, v: s + v * v, 0.0, name="energy", returns="double")
    return f.df.select("event_id", F.round("energy", 4).alias("energy"))


@query("pairwise", f"SELECT event_id, prev, value AS cur FROM (SELECT *, lag(value) OVER w AS prev, row_number() OVER w AS rn FROM events WINDOW w AS ({BY_USER})) WHERE rn > 1")
def pairwise(spark, sf):
    return events(spark, sf).pairwise().df.select("event_id", "prev", "cur")


@query(
    "pairwise_global",
    """SELECT conv_id, turn, prev, role AS cur FROM (SELECT *, lag(role) OVER w AS prev, row_number() OVER w AS rn FROM conversations WINDOW w AS (ORDER BY conv_id, turn)) WHERE rn > 1""",
)
def pairwise_global(spark, sf):
    f = Flow(table(spark, sf, "conversations"), ("conv_id", "turn"), value="role", wide=True)
    return f.pairwise().df.select("conv_id", "turn", "prev", "cur")


_WINDOWS = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "variance": "var_pop", "std": "stddev_pop"}


def _windowed(op: str, sql: str) -> None:
    @query(
        f"windowed_{op}",
        f"""SELECT event_id, round({op}, 5) AS {op} FROM (SELECT event_id, {sql}(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS {op}, row_number() OVER w AS rn
        FROM events WINDOW w AS ({BY_USER})) WHERE rn >= 5""",
    )
    def run(spark, sf):
        return events(spark, sf).windowed(5, op).df.select("event_id", F.round(op, 5).alias(op))


for _op, _sql in _WINDOWS.items():
    _windowed(_op, _sql)


@query(
    "windowed_step",
    f"""SELECT event_id, round(total, 5) AS total FROM (SELECT event_id, sum(value) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS total, row_number() OVER w AS rn
    FROM events WINDOW w AS ({BY_USER})) WHERE rn >= 6 AND (rn - 6) % 3 = 0""",
)
def windowed_step(spark, sf):
    return events(spark, sf).windowed(6, "sum", "total", step=3).df.select("event_id", F.round("total", 5).alias("total"))


@query(
    "windowed_global",
    """SELECT event_id, round(m, 5) AS m FROM (SELECT event_id, avg(value) OVER (w ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS m, row_number() OVER w AS rn
    FROM events WINDOW w AS (ORDER BY ts, event_id)) WHERE rn >= 100""",
)
def windowed_global(spark, sf):
    return events(spark, sf, keyed=False, wide=True).windowed(100, "mean", "m").df.select("event_id", F.round("m", 5).alias("m"))


@query(
    "window_rows",
    f"""SELECT event_id, array_to_string(list_transform(items, lambda x: CAST(x AS VARCHAR)), ',') AS items FROM (SELECT event_id, list(event_id) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS items, row_number() OVER w AS rn
    FROM events WINDOW w AS ({BY_USER})) WHERE rn >= 3""",
)
def window_rows(spark, sf):
    f = events(spark, sf, value="event_id").windowed(3, "collect", "items")
    return f.df.select("event_id", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"))


@query("buffer", f"""SELECT user_id, (rn - 1) // 7 AS chunk, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS items FROM (SELECT user_id, event_id, row_number() OVER ({BY_USER}) AS rn FROM events) GROUP BY ALL""")
def buffer_query(spark, sf):
    f = events(spark, sf, value="event_id").buffer(7)
    return f.df.select("user_id", "chunk", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"))


@query("buffer_global", """SELECT (rn - 1) // 1000 AS chunk, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) GROUP BY ALL""")
def buffer_global(spark, sf):
    f = events(spark, sf, keyed=False, value="event_id", wide=True).buffer(1000)
    return f.df.select("chunk", F.size("items").cast("long").alias("n"), F.array_min("items").alias("lo"), F.array_max("items").alias("hi"))


@query("distinct", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def distinct_query(spark, sf):
    return events(spark, sf, value="event_type").distinct().df.select("user_id", "event_type", "event_id")


@query(
    "distinct_until_changed",
    f"""SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS rn FROM events WINDOW w AS ({BY_USER})) WHERE rn = 1 OR event_type IS DISTINCT FROM prev""",
)
def distinct_until_changed(spark, sf):
    return events(spark, sf, value="event_type").distinct_until_changed().df.select("event_id", "event_type")


# ---------------------------------------------------------------- terminals

_TERMINALS = {
    "sum": ("round(coalesce(sum(value), 0), 3)", lambda f: r3(f.sum(), "sum")),
    "min": ("min(value)", lambda f: f.min()),
    "max": ("max(value)", lambda f: f.max()),
    "mean": ("round(avg(value), 6)", lambda f: r3(f.mean(), "mean", 6)),
    "count": ("count(*)", lambda f: f.count()),
    "first": ("arg_min(value, {'t': ts, 'e': event_id})", lambda f: f.first()),
    "last": ("arg_max(value, {'t': ts, 'e': event_id})", lambda f: f.last()),
    "found": ("arg_min(value, {'t': ts, 'e': event_id}) FILTER (WHERE value > 100)", lambda f: f.find(lambda v: v > 100)),
    "all": ("coalesce(bool_and(coalesce(value > 0, false)), true)", lambda f: f.all(lambda v: v > 0)),
    "some": ("coalesce(bool_or(value > 300), false)", lambda f: f.some(lambda v: v > 300)),
    "reduce": ("round(coalesce(sum(value), 0) + 100, 3)", lambda f: r3(f.reduce("sum", 100.0), "reduce")),
}


def r3(df, name: str, digits: int = 3):
    return df.withColumn(name, F.round(name, digits))


def _terminal(name: str, sql: str, fn) -> None:
    query(f"terminal_{name}", f"SELECT {sql} AS \"{name}\" FROM events")(lambda spark, sf: fn(events(spark, sf, keyed=False)))
    query(f"terminal_{name}_by_key", f"SELECT user_id, {sql} AS \"{name}\" FROM events GROUP BY user_id")(lambda spark, sf: fn(events(spark, sf)))


for _name, (_sql, _fn) in _TERMINALS.items():
    _terminal(_name, _sql, _fn)


@query("reduce_python", "SELECT user_id, round(sum(value * value), 4) AS reduce FROM events GROUP BY user_id")
def reduce_python(spark, sf):
    return r3(terminals.reduce(events(spark, sf), lambda s, v: s + v * v, 0.0, "double"), "reduce", 4)


# ---------------------------------------------------------------- failing elements

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def _quotient():
    """100 / (k - 50), which fails at 50."""
    k = F.get_json_object("props", "$.k").cast("long")
    return F.try_divide(F.lit(100.0), (k - 50).cast("double"))


@query("errors_dropped", f"SELECT event_id, round(100.0::DOUBLE / ({_K} - 50), 6) AS q FROM events WHERE {_K} <> 50")
def errors_dropped(spark, sf):
    return errors.attempt(events(spark, sf), _quotient(), name="q").drop().df.select("event_id", r6(F.col("q")).alias("q"))


@query("errors_rescued", f"SELECT event_id, CASE WHEN {_K} = 50 THEN -1.0::DOUBLE ELSE round(100.0::DOUBLE / ({_K} - 50), 6) END AS q FROM events")
def errors_rescued(spark, sf):
    return errors.attempt(events(spark, sf), _quotient(), name="q").rescue(-1.0).df.select("event_id", r6(F.col("q")).alias("q"))


@query(
    "errors_terminate",
    f"""SELECT event_id, round(100.0::DOUBLE / (k - 50), 6) AS q FROM (SELECT event_id, {_K} AS k, sum(CASE WHEN {_K} = 50 THEN 1 ELSE 0 END) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS fails FROM events) WHERE fails = 0""",
)
def errors_terminate(spark, sf):
    return errors.attempt(events(spark, sf), _quotient(), name="q").terminate().df.select("event_id", r6(F.col("q")).alias("q"))


@query("errors_python", f"SELECT event_id, CASE WHEN {_K} = 50 THEN 'ZeroDivisionError' ELSE CAST(100 // ({_K} - 50) + CASE WHEN {_K} < 50 AND 100 % ({_K} - 50) <> 0 THEN -1 ELSE 0 END AS VARCHAR) END AS q FROM events")
def errors_python(spark, sf):
    """A Python function on Arrow batches; what it raises becomes the element's value."""
    import json

    got = errors.attempt_python(events(spark, sf, value="props"), lambda p: str(100 // (json.loads(p)["k"] - 50)), "string", retries=1, name="q")
    return got.rescue(lambda error: F.split(error, ":")[0]).df.select("event_id", "q")
