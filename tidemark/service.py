"""A work queue as tables: admission, processing passes, purging, status and history.

An item is a row (requestId, payload, status, createdAt, updatedAt, retries); times are milliseconds.
Statuses: queued, processing, completed, failed. A pass takes the first items that are queued, in order
of (createdAt, requestId), and is a pure function of the table and of each item's outcome, so a caller
may write each pass to a table and start over from it after a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flow import Flow
from .frames import data_payload, error_payload, frame
from .operators.timing import rate_limit

ITEM = "requestId string, payload string, status string, createdAt long, updatedAt long, retries int"
PER_PASS = 10
TRIES = 3
KEEP_MS = 3_600_000
ADMIT_WINDOW_MS, ADMIT_MOST = 60_000, 1000
HISTORY = 100


def admit(requests: Flow, window_ms: int = ADMIT_WINDOW_MS, most: int = ADMIT_MOST) -> Flow:
    """Requests in time order -> accepted: whether the limiter lets each in."""
    return requests.of(rate_limit(requests, window_ms, most).df.drop("rate"))


def enqueued(requests: DataFrame, request_id: str, payload: str, at_ms: Column) -> DataFrame:
    return requests.select(F.col(request_id).cast("string").alias("requestId"), F.col(payload).cast("string").alias("payload"), F.lit("queued").alias("status"), at_ms.cast("long").alias("createdAt"), at_ms.cast("long").alias("updatedAt"), F.lit(0).alias("retries"))


def next_items(queue: DataFrame, n: int = PER_PASS) -> DataFrame:
    return queue.filter(F.col("status") == "queued").orderBy("createdAt", "requestId").limit(n)


def processed(queue: DataFrame, succeeds: Column, now_ms: int, n: int = PER_PASS, tries: int = TRIES) -> DataFrame:
    """The table after one pass. succeeds: a condition on an item; failing items are queued again until their last try."""
    taken = next_items(queue, n).select(F.col("requestId").alias("_id"))  # at most n rows
    rows = queue.join(F.broadcast(taken), F.col("requestId") == F.col("_id"), "left")
    on, ok = F.col("_id").isNotNull(), F.coalesce(succeeds, F.lit(False))
    retries = F.col("retries") + F.when(on & ~ok, 1).otherwise(0)
    status = F.when(on & ok, "completed").when(on & (retries >= tries), "failed").when(on, "queued").otherwise(F.col("status"))
    return rows.select("requestId", "payload", status.alias("status"), "createdAt", F.when(on, F.lit(now_ms)).otherwise(F.col("updatedAt")).cast("long").alias("updatedAt"), retries.cast("int").alias("retries"))


def purged(queue: DataFrame, now_ms: int, keep_ms: int = KEEP_MS) -> DataFrame:
    """Without items that were completed keep_ms ago or earlier."""
    return queue.filter((F.col("status") != "completed") | (F.lit(now_ms) - F.col("updatedAt") < keep_ms))


def status(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("items"))


def item_status(queue: DataFrame, request_id: str) -> DataFrame:
    return queue.filter(F.col("requestId") == request_id).select("requestId", "status", "createdAt", "updatedAt")


def history(queue: DataFrame, request_id: str | None = None, limit: int = HISTORY) -> DataFrame:
    """The first items as JSON lines, in order of (createdAt, requestId)."""
    rows = queue if request_id is None else queue.filter(F.col("requestId") == request_id)
    first = rows.orderBy("createdAt", "requestId").limit(limit)
    return first.select("requestId", F.to_json(F.struct("requestId", "payload", "status", "createdAt", "updatedAt", "retries")).alias("line"))


def result_frames(before: DataFrame, after: DataFrame, now_ms: int, tries: int = TRIES) -> DataFrame:
    """What a pass tells its subscribers: a data frame for each item completed, an error frame for each failure."""
    was = before.select("requestId", F.col("status").alias("_was"), F.col("retries").alias("_tried"))
    both = after.join(was, "requestId")
    done = (F.col("status") == "completed") & (F.col("_was") != "completed")
    failed = F.col("retries") > F.col("_tried")
    result = F.encode(F.to_json(F.struct("requestId", F.lit("processed").alias("result"), F.lit(now_ms).alias("timestamp"))), "UTF-8")
    payload = F.when(done, data_payload(result)).otherwise(error_payload(F.lit(500), F.lit("Processing failed"), F.col("retries") < tries))
    return both.filter(done | failed).select("requestId", frame(payload, F.lit(0), F.lit(now_ms)).alias("frame"))


def broadcast(frames: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Frames (`sequence` from 0, without gaps) to subscribers (stream, credits): each delivery costs one credit.

    A stream gets the first `credits` frames. Each subscriber asks for just the places that it will get,
    so the join is an equi-join as large as what is delivered.
    """
    n = frames.agg(F.count(F.lit(1)).alias("_n"))  # one row
    asked = subscribers.crossJoin(F.broadcast(n)).withColumn("_take", F.least(F.col("credits").cast("long"), F.col("_n"))).filter("_take > 0")
    places = asked.select("stream", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_take") - 1)).alias("sequence"))
    return places.join(frames, "sequence").select("stream", *frames.columns)
