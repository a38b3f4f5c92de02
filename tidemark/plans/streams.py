"""Queries that run stateful operators through Structured Streaming, to the end of what is there.

Each writes its micro-batches as Parquet in the shared folder and returns the table that results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..flow import Flow
from ..ordering import estimated_bytes
from ..sources import unbounded
from ..streaming import stateful
from ..streaming.whole import Running
from .flows import _WINDOWS
from .registry import ORACLES, query, shared_folder, table
from .served import read_until
from .timed import _LIMIT, _ROWS, HOUR

BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf: str, closing: str | None = None, delay: str = "1 hour") -> DataFrame:
    """events as a stream in event time (ts as TIMESTAMP, since watermarks need it), and what comes into the folder `closing`."""
    read = spark.readStream.schema(SCHEMA).parquet(f"{sf}/events.parque[t]")  # a pattern, as the table may be one file
    if closing:
        read = read.union(spark.readStream.schema(SCHEMA).parquet(closing))
    return read.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _ended(spark: SparkSession, at: str, start: Callable[[str], StreamingQuery]) -> None:
    """Runs what `start` starts (given a closing folder) over all there is, to its end: that folder has rows of the far
    future, so that the watermark passes everything held or pending. The sources are read whole in the first micro-batch,
    and those rows with them; what they make due comes in the next, so nothing is read or carried on twice. They have no
    user and stay in state themselves; there is one of each type, as queries look at some types only."""
    rows = [(None, None, None, kind, None, None) for kind in ("click", "error", "purchase", "signup", "view")]
    far = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.expr("TIMESTAMP_NTZ'2200-01-01 00:00:00'")).coalesce(1)
    far.write.parquet(f"{at}/closing")
    start(f"{at}/closing").awaitTermination()
    _remove(spark, f"{at}/closing")
    # The sink's own log names the files that count, so it stays with them; the query's checkpoint can go.
    _remove(spark, f"{at}/log")


def _partitions(spark: SparkSession, sf: str) -> int:
    """How many partitions of state the events are worth, as each costs every micro-batch some tenths of a second: one for
    8 MB of the table, two a core at least; no more than a shuffle has."""
    worth = max(estimated_bytes(table(spark, sf, "events")) >> 23, 2 * spark.sparkContext.defaultParallelism)
    return min(worth, int(spark.conf.get("spark.sql.shuffle.partitions")))


def run_to_end(spark: SparkSession, build: Callable[[str], DataFrame], mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Runs the stream that `build` makes of a closing folder to its end. Returns what was written."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    made: list[DataFrame] = []

    def start(closing: str) -> StreamingQuery:
        made.append(build(closing))
        own = spark.conf.get("spark.sql.shuffle.partitions")
        try:  # a stream keeps the number that it starts with
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions or own))
            return made[0].writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", own)

    _ended(spark, at, start)
    return spark.read.schema(made[0].schema).parquet(f"{at}/out")


def run_whole(spark: SparkSession, build: Callable[[str], Flow], kind: str, value: Column) -> DataFrame:
    """The running aggregate `scan` of a stream without a key, to its end."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    made: list[Running] = []

    def start(closing: str) -> StreamingQuery:
        made.append(Running(build(closing), kind, value, at))
        return made[0].stream.df.writeStream.foreachBatch(made[0]).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()

    _ended(spark, at, start)
    _remove(spark, f"{at}/waiting")
    _remove(spark, f"{at}/carried")
    return made[0].result()


def _to_end(spark, sf, operator: Callable[[Flow], DataFrame], value: str = "value", also: tuple = ()) -> DataFrame:
    """The operator over the events as a stream by user; only the order, the value and the columns in `also` are held."""
    columns = list(dict.fromkeys(("event_id", "ts", "user_id", value, *also)))
    rows = lambda closing: Flow(event_stream(spark, sf, closing).select(*columns), ("ts", "event_id"), ("user_id",), "ts", value)
    return run_to_end(spark, lambda closing: operator(rows(closing)), partitions=_partitions(spark, sf))


@query("stream_map_filter", "SELECT event_id, value * 2 AS doubled FROM events WHERE value > 50")
def stream_map_filter(spark, sf):
    return _to_end(spark, sf, lambda f: f.filter(lambda v: v > 50).map(lambda v: v * 2, name="doubled").df.select("event_id", "doubled"))


@query("stream_scan", f"SELECT event_id, round(sum(value) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING), 3) AS scan FROM events")
def stream_scan(spark, sf):
    return _to_end(spark, sf, lambda f: stateful.scan(f, lambda s, v: s + v, 0.0, "double").select("event_id", "scan")).withColumn("scan", F.round("scan", 3))


@query("stream_scan_global", "SELECT event_id, count(*) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS scan FROM events")
def stream_scan_global(spark, sf):
    """A stream without a key."""
    rows = lambda closing: Flow(event_stream(spark, sf, closing).select("event_id", "ts"), ("ts", "event_id"), (), "ts")
    return run_whole(spark, rows, "count", F.lit(1)).select("event_id", "scan")


@query("stream_skip", f"SELECT event_id FROM events QUALIFY row_number() OVER ({BY_USER}) > 3")
def stream_skip(spark, sf):
    return _to_end(spark, sf, lambda f: stateful.skip(f, 3).select("event_id"))


@query("stream_take", f"SELECT event_id FROM events QUALIFY row_number() OVER ({BY_USER}) <= 3")
def stream_take(spark, sf):
    return _to_end(spark, sf, lambda f: stateful.take(f, 3).select("event_id"))


@query("stream_pairwise", f"SELECT event_id, prev, value AS cur FROM (SELECT *, lag(value) OVER w AS prev, row_number() OVER w AS rn FROM events WINDOW w AS ({BY_USER})) WHERE rn > 1")
def stream_pairwise(spark, sf):
    return _to_end(spark, sf, lambda f: stateful.pairwise(f).select("event_id", "prev", "cur"))


@query(
    "stream_distinct_until_changed",
    f"""SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS rn FROM events WINDOW w AS ({BY_USER})) WHERE rn = 1 OR event_type IS DISTINCT FROM prev""",
)
def stream_distinct_until_changed(spark, sf):
    return _to_end(spark, sf, lambda f: stateful.distinct_until_changed(f).select("event_id", "event_type"), "event_type")


@query("stream_distinct", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def stream_distinct(spark, sf):
    return _to_end(spark, sf, lambda f: stateful.distinct(f).select("event_id"), "event_type")


def _windowed(op: str, sql: str) -> None:
    @query(
        f"stream_windowed_{op}",
        f"""SELECT event_id, round({op}, 5) AS {op} FROM (SELECT event_id, {sql}(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS {op}, row_number() OVER w AS rn
        FROM events WINDOW w AS ({BY_USER})) WHERE rn >= 5""",
    )
    def run(spark, sf):
        return _to_end(spark, sf, lambda f: stateful.windowed(f, 5, op).select("event_id", op)).withColumn(op, F.round(op, 5))


for _op in ("mean", "std"):
    _windowed(_op, _WINDOWS[_op])


@query(
    "stream_throttle",
    f"""WITH RECURSIVE {_ROWS},
    r AS (SELECT user_id, event_id, rn, ms AS last, true AS passed FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.ms - r.last >= {12 * HOUR} THEN e.ms ELSE r.last END, e.ms - r.last >= {12 * HOUR}
      FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
    SELECT event_id FROM r WHERE passed""",
)
def stream_throttle(spark, sf):
    return _to_end(spark, sf, lambda f: stateful.throttle(f, 12 * HOUR).select("event_id"))


@query("stream_rate_limit", _LIMIT.format(rows=_ROWS, window=24 * HOUR))
def stream_rate_limit(spark, sf):
    return _to_end(spark, sf, lambda f: stateful.rate_limit(f, 24 * HOUR, 2).select("event_id", "accepted", "rate")).withColumn("rate", F.round("rate", 9))


def _both(f: Flow) -> Flow:
    return f.of(stateful.merge(f.df.filter("event_type = 'click'"), f.df.filter("event_type = 'view'")))


_SEEN = f"""WITH l AS (SELECT user_id, event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS click, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS view
      FROM events WHERE event_type IN ('click', 'view') WINDOW w AS ({BY_USER} ROWS UNBOUNDED PRECEDING))
    SELECT event_id, click, view FROM l WHERE click IS NOT NULL AND view IS NOT NULL"""


@query("stream_combine_latest", _SEEN)
def stream_combine_latest(spark, sf):
    return _to_end(spark, sf, lambda f: stateful.combine_latest(_both(f), "event_type", ("click", "view"), ("click", "view")).select("event_id", "click", "view"), also=("event_type",))


@query("stream_with_latest_from", _SEEN + " AND event_type = 'click'")
def stream_with_latest_from(spark, sf):
    return _to_end(spark, sf, lambda f: stateful.with_latest_from(_both(f), "event_type", "click", ("view",), ("click", "view")).select("event_id", "click", "view"), also=("event_type",))


@query(
    "stream_buffer",
    f"""SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS items
    FROM (SELECT *, (row_number() OVER ({BY_USER}) - 1) // 7 AS chunk FROM events) GROUP BY user_id, chunk""",
)
def stream_buffer(spark, sf):
    out = _to_end(spark, sf, lambda f: stateful.buffer(f, 7, 24 * 366 * HOUR).select("user_id", "items"), "event_id")
    return out.select("user_id", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"))


@query(
    "stream_start_with",
    """SELECT user_id, event_id, value, CAST(0 AS INTEGER) AS lead FROM events UNION ALL
    SELECT user_id, NULL, v, CAST(p AS INTEGER) FROM (SELECT DISTINCT user_id FROM events), (VALUES (-2, -1.0::DOUBLE), (-1, 0.5::DOUBLE)) t(p, v)""",
)
def stream_start_with(spark, sf):
    return _to_end(spark, sf, lambda f: stateful.start_with(f, -1.0, 0.5).select("user_id", "event_id", "value", F.col("_lead").alias("lead")))


@query("stream_debounce", ORACLES["debounce"])
def stream_debounce(spark, sf):
    return _to_end(spark, sf, lambda f: stateful.debounce(f, 6 * HOUR).select("event_id"))


@query(
    "stream_buffer_time",
    f"""SELECT user_id, epoch_us(ts) // ({24 * HOUR} * 1000::BIGINT) AS day, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS items FROM events GROUP BY ALL""",
)
def stream_buffer_time(spark, sf):
    """Items by day and user."""
    items = lambda f: stateful.buffer_time(f.df, "ts", 24 * HOUR, "event_id", ("user_id",), ("event_id",))
    day = F.floor(F.unix_millis("window.start") / (24 * HOUR)).alias("day")
    return _to_end(spark, sf, items).select("user_id", day, F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"))


TICKS = 50


@query("stream_interval", f"SELECT range AS value FROM range({TICKS})")
def stream_interval(spark, sf):
    """The first ticks of an interval, as (value): the stream is stopped once they are there."""
    return read_until(spark, unbounded.interval(spark, 50).select("value"), TICKS).filter(F.col("value") < TICKS)
