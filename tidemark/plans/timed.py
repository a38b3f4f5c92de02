"""Queries of time operators, flow control, frames and the work queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import flowcontrol, frames, service
from ..flow import Flow
from ..operators import timing
from .registry import ORACLES, events, query, table

HOUR = 3_600_000
BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"


@query("debounce", f"""SELECT event_id FROM (SELECT event_id, epoch_us(lead(ts) OVER ({BY_USER})) - epoch_us(ts) AS gap FROM events) WHERE gap IS NULL OR gap >= {6 * HOUR} * 1000::BIGINT""")
def debounce(spark, sf):
    return events(spark, sf).debounce(6 * HOUR).df.select("event_id")


@query("debounce_global", f"""SELECT event_id FROM (SELECT event_id, epoch_us(lead(ts) OVER (ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM events) WHERE gap IS NULL OR gap >= {HOUR // 4} * 1000::BIGINT""")
def debounce_global(spark, sf):
    return events(spark, sf, keyed=False, wide=True).debounce(HOUR // 4).df.select("event_id")


_ROWS = f"""e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) // 1000 AS ms, CAST(json_extract(props, '$.k') AS BIGINT) AS k, row_number() OVER ({BY_USER}) AS rn FROM events)"""


@query(
    "throttle",
    f"""WITH RECURSIVE {_ROWS},
    r AS (SELECT user_id, event_id, rn, ms AS last, true AS passed FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.ms - r.last >= {12 * HOUR} THEN e.ms ELSE r.last END, e.ms - r.last >= {12 * HOUR}
      FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
    SELECT event_id FROM r WHERE passed""",
)
def throttle(spark, sf):
    return events(spark, sf).throttle(12 * HOUR).df.select("event_id")


def _times(spark, sf) -> Flow:
    """The events' times, without a key; folds carry all columns that they are given."""
    whole = events(spark, sf, keyed=False, wide=True)
    return whole.of(whole.df.select("event_id", "ts"))


@query(
    "throttle_global",
    f"""WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events),
    r AS (SELECT min(ms) AS ms FROM e UNION ALL SELECT * FROM (SELECT min(e.ms) AS ms FROM r, e WHERE e.ms >= r.ms + {6 * HOUR}) WHERE ms IS NOT NULL)
    SELECT min(event_id) AS event_id FROM e JOIN r USING (ms) GROUP BY ms""",
)
def throttle_global(spark, sf):
    return _times(spark, sf).throttle(6 * HOUR).df.select("event_id")


_LIMIT = """WITH RECURSIVE {rows},
    r AS (SELECT user_id, event_id, rn, [ms] AS acc, true AS accepted FROM e WHERE rn = 1
      UNION ALL SELECT user_id, event_id, rn, CASE WHEN len(live) < 2 THEN list_append(live, ms) ELSE live END, len(live) < 2 FROM
        (SELECT e.user_id, e.event_id, e.rn, e.ms, list_filter(r.acc, lambda t: t > e.ms - {window}) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
    SELECT event_id, accepted, round(len(acc) * 1000.0::DOUBLE / {window}, 9) AS rate FROM r"""


@query("rate_limit", _LIMIT.format(rows=_ROWS, window=24 * HOUR))
def rate_limit(spark, sf):
    return timing.rate_limit(events(spark, sf), 24 * HOUR, 2).df.select("event_id", "accepted", F.round("rate", 9).alias("rate"))


@query(
    "buffer_time",
    f"""SELECT user_id, w AS "window", string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS items FROM
    (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // ({24 * HOUR} * 1000::BIGINT) AS w FROM events) GROUP BY user_id, w""",
)
def buffer_time(spark, sf):
    f = events(spark, sf, value="event_id").buffer_time(24 * HOUR)
    return f.df.select("user_id", "window", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"))


@query("buffer_time_global", f"""SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // ({HOUR} * 1000::BIGINT) AS "window", count(*) AS n FROM events GROUP BY 1""")
def buffer_time_global(spark, sf):
    f = events(spark, sf, keyed=False, value="event_id").buffer_time(HOUR)
    return f.df.select("window", F.size("items").cast("long").alias("n"))


# ---------------------------------------------------------------- flow control


@query(
    "credits",
    f"""WITH RECURSIVE {_ROWS}, c AS (SELECT *, CASE event_type WHEN 'signup' THEN 'reset' WHEN 'purchase' THEN 'add' ELSE 'take' END AS op, k % 7 AS amount FROM e),
    r AS (SELECT user_id, event_id, rn, CASE op WHEN 'take' THEN 10 >= amount END AS granted, CASE op WHEN 'take' THEN CASE WHEN 10 >= amount THEN 10 - amount ELSE 10 END WHEN 'add' THEN 10 + amount ELSE 10 END AS lft FROM c WHERE rn = 1
      UNION ALL SELECT c.user_id, c.event_id, c.rn, CASE op WHEN 'take' THEN lft >= amount END, CASE op WHEN 'take' THEN CASE WHEN lft >= amount THEN lft - amount ELSE lft END WHEN 'add' THEN lft + amount ELSE 10 END
      FROM r JOIN c ON c.user_id = r.user_id AND c.rn = r.rn + 1)
    SELECT event_id, granted, CAST(lft AS BIGINT) AS "left" FROM r""",
)
def credit_query(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    op = F.when(F.col("event_type") == "signup", "reset").when(F.col("event_type") == "purchase", "add").otherwise("take")
    f = events(spark, sf)
    calls = f.of(f.df.select("user_id", "ts", "event_id", op.alias("op"), (k % 7).alias("amount")))
    return flowcontrol.credit_calls(calls, 10).df.select("event_id", "granted", "left")


_RATE = "greatest(10.0::DOUBLE, least(1000.0::DOUBLE, {rate} * (1 + 0.2::DOUBLE * (20.0::DOUBLE - {lat}) / 20.0::DOUBLE)))"


@query(
    "adaptive_rate",
    f"""WITH RECURSIVE {_ROWS},
    r AS (SELECT user_id, event_id, rn, {_RATE.format(rate="100.0::DOUBLE", lat="value")} AS rate FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.event_id, e.rn, {_RATE.format(rate="r.rate", lat="e.value")} FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
    SELECT event_id, floor(rate * 1e6::DOUBLE + 0.31371::DOUBLE) / 1e6::DOUBLE AS rate, CAST(floor(1000 / rate) AS BIGINT) AS delay_ms FROM r""",
)
def adaptive_rate(spark, sf):
    return flowcontrol.adaptive_rates(events(spark, sf), 100, 20, 10, 1000).df.select("event_id", (F.floor(F.col("rate") * 1e6 + 0.31371) / F.lit(1e6)).alias("rate"), "delay_ms")  # cut where no decimal tie lies


@query(
    "dynamic_backpressure",
    f"""WITH RECURSIVE {_ROWS},
    r AS (SELECT user_id, event_id, rn, k < 80 AND value <= 40 AND k * 3.0::DOUBLE <= 100 AS accepted, {_RATE.format(rate="100.0::DOUBLE", lat="value")} AS rate FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.event_id, e.rn, e.k < 80 AND e.value <= 40 AND e.k * 3.0::DOUBLE <= r.rate, {_RATE.format(rate="r.rate", lat="e.value")} FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
    SELECT event_id, accepted FROM r""",
)
def dynamic_backpressure(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    f = events(spark, sf)
    metrics = f.of(f.df.select("user_id", "ts", "event_id", k.alias("queue_size"), (k * 3.0).alias("input_rate"), F.col("value").alias("latency_ms")))
    return flowcontrol.dynamic_decisions(metrics, 80, 20).df.select("event_id", "accepted")


# ---------------------------------------------------------------- frames


@query("frames", f"""SELECT event_id, row_number() OVER ({BY_USER}) - 1 AS sequence, epoch_us(ts) // 1000 AS timestamp, props AS text, CASE WHEN event_type = 'error' THEN 'error' ELSE 'data' END AS kind FROM events""")
def frames_query(spark, sf):
    """Events as frames, over the wire and back."""
    f = events(spark, sf)
    payload = F.when(F.col("event_type") == "error", frames.error_payload(F.lit(500), F.col("props"), F.lit(True))).otherwise(frames.data_payload(F.encode("props", "UTF-8")))
    made = frames.numbered(f, payload, F.unix_millis(F.col("ts").cast("timestamp")))
    back = frames.decode(frames.encode(F.col("frame")))
    p = F.col("back.payload")
    return made.df.withColumn("back", back).select("event_id", "back.sequence", "back.timestamp", F.when(frames.is_type(F.col("back"), "error"), p["error"]).otherwise(F.decode(p["data"], "UTF-8")).alias("text"), p["type"].alias("kind"))


@query("frames_compact", ORACLES["frames"])
def frames_compact(spark, sf):
    """Events as frames in the compact form and back, some of them by way of JSON (those without a timestamp)."""
    f = events(spark, sf)
    payload = F.when(F.col("event_type") == "error", frames.error_payload(F.lit(500), F.col("props"), F.lit(True))).otherwise(frames.data_payload(F.encode("props", "UTF-8")))
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    made = frames.numbered(f, payload, F.when(F.col("event_id") % 10 > 0, at))
    back = made.df.withColumn("back", frames.decode_compact(frames.encode_compact(F.col("frame"))))
    p = F.col("back.payload")
    text = F.when(frames.is_type(F.col("back"), "error"), p["error"]).otherwise(F.decode(p["data"], "UTF-8"))
    return back.select("event_id", "back.sequence", F.coalesce("back.timestamp", at).alias("timestamp"), text.alias("text"), p["type"].alias("kind"))


_HEX = "SELECT doc_id, hex(encode(text)) AS h FROM documents"


@query(
    "chunks",
    f"""SELECT doc_id, CAST(k AS BIGINT) AS sequence, md5(substr(h, CAST(k * 2000 + 1 AS BIGINT), 2000)) AS mark FROM
    (SELECT doc_id, h, unnest(range(CAST(ceil(len(h) / 2000.0) AS BIGINT))) AS k FROM ({_HEX}))""",
)
def chunks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return frames.chunked(docs, "raw", ["doc_id"], 1000).select("doc_id", "sequence", F.md5(F.hex("chunk").cast("binary")).alias("mark"))


@query(
    "chunks_joined",
    f"""SELECT doc_id, CAST(k AS BIGINT) AS piece, md5(substr(h, CAST(k * 20000 + 1 AS BIGINT), 20000)) AS mark FROM
    (SELECT doc_id, h, unnest(range(CAST(ceil(len(h) / 20000.0) AS BIGINT))) AS k FROM ({_HEX}))""",
)
def chunks_joined(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    back = frames.joined(frames.chunked(docs, "raw", ["doc_id"], 1000), ["doc_id"])
    return back.select("doc_id", "piece", F.md5(F.hex("data").cast("binary")).alias("mark"))


# ---------------------------------------------------------------- the work queue

_QUEUE = """q AS (SELECT CAST(event_id AS VARCHAR) AS "requestId", props AS payload, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status,
    epoch_us(ts) // 1000 AS "createdAt", epoch_us(ts) // 1000 + CAST(value * 1000 AS BIGINT) AS "updatedAt", CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS INTEGER) AS retries FROM events)"""
_NOW = 1_704_700_000_000


def queue_items(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "error", "failed").otherwise("queued")
    return table(spark, sf, "events").select(F.col("event_id").cast("string").alias("requestId"), F.col("props").alias("payload"), kind.alias("status"), at.alias("createdAt"), (at + F.rint(F.col("value") * 1000).cast("long")).alias("updatedAt"), (k % 3).cast("int").alias("retries"))


@query("queue_status", f"WITH {_QUEUE} SELECT status, count(*) AS items FROM q GROUP BY status")
def queue_status(spark, sf):
    return service.status(queue_items(spark, sf))


@query(
    "queue_pass",
    f"""WITH {_QUEUE}, t AS (SELECT "requestId" AS id FROM q WHERE status = 'queued' ORDER BY "createdAt", "requestId" LIMIT 10)
    SELECT "requestId", CASE WHEN id IS NULL THEN status WHEN payload LIKE '%7%' THEN CASE WHEN retries + 1 >= 3 THEN 'failed' ELSE 'queued' END ELSE 'completed' END AS status,
    CASE WHEN id IS NULL THEN "updatedAt" ELSE {_NOW} END AS "updatedAt", CAST(retries + CASE WHEN id IS NOT NULL AND payload LIKE '%7%' THEN 1 ELSE 0 END AS INTEGER) AS retries
    FROM q LEFT JOIN t ON id = "requestId" """,
)
def queue_pass(spark, sf):
    return service.processed(queue_items(spark, sf), ~F.col("payload").contains("7"), _NOW).select("requestId", "status", "updatedAt", "retries")


@query("queue_purge", f"""WITH {_QUEUE} SELECT "requestId", status FROM q WHERE status <> 'completed' OR {_NOW} - "updatedAt" < 3600000""")
def queue_purge(spark, sf):
    return service.purged(queue_items(spark, sf), _NOW).select("requestId", "status")


@query(
    "queue_history",
    f"""WITH {_QUEUE} SELECT "requestId", '{{"requestId":"' || "requestId" || '","payload":"' || replace(payload, '"', '\\"') || '","status":"' || status || '","createdAt":' || "createdAt" || ',"updatedAt":' || "updatedAt" || ',"retries":' || retries || '}}' AS line
    FROM q ORDER BY "createdAt", "requestId" LIMIT 100""",
)
def queue_history(spark, sf):
    return service.history(queue_items(spark, sf))


@query(
    "queue_admission",
    f"""WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events),
    r AS (SELECT event_id, rn, [ms] AS acc, true AS accepted FROM e WHERE rn = 1
      UNION ALL SELECT event_id, rn, CASE WHEN len(live) < 2 THEN list_append(live, ms) ELSE live END, len(live) < 2 FROM
        (SELECT e.event_id, e.rn, e.ms, list_filter(r.acc, lambda t: t > e.ms - {HOUR // 4}) AS live FROM r JOIN e ON e.rn = r.rn + 1))
    SELECT event_id, accepted FROM r""",
)
def queue_admission(spark, sf):
    """Requests let in by the limiter, over the whole table in time order (at most two in a quarter of an hour)."""
    return service.admit(_times(spark, sf), HOUR // 4, 2).df.select("event_id", "accepted")


@query(
    "queue_results",
    f"""WITH {_QUEUE}, t AS (SELECT "requestId" AS id FROM q WHERE status = 'queued' ORDER BY "createdAt", "requestId" LIMIT 10)
    SELECT "requestId", CASE WHEN payload LIKE '%7%' THEN 'error' ELSE 'data' END AS kind, CASE WHEN payload LIKE '%7%' THEN retries + 1 < 3 END AS recoverable FROM q JOIN t ON id = "requestId" """,
)
def queue_results(spark, sf):
    """What a pass tells its subscribers."""
    before = queue_items(spark, sf)
    told = service.result_frames(before, service.processed(before, ~F.col("payload").contains("7"), _NOW), _NOW)
    p = F.col("frame.payload")
    return told.select("requestId", p["type"].alias("kind"), p["recoverable"].alias("recoverable"))


@query("broadcast", """SELECT CAST(s_suppkey AS VARCHAR) AS stream, sequence, name FROM supplier JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS sequence, n_name AS name FROM nation) ON sequence < s_suppkey % 40""")
def broadcast(spark, sf):
    """A frame for each nation to a subscriber for each supplier, as far as its credits reach."""
    f = Flow(table(spark, sf, "nation"), ("n_nationkey",), value="n_name")
    made = frames.numbered(f, frames.data_payload(F.encode("n_name", "UTF-8")), F.lit(0)).df.select("frame.sequence", "frame")
    subscribers = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("stream"), (F.col("s_suppkey") % 40).cast("int").alias("credits"))
    return service.broadcast(made, subscribers).select("stream", "sequence", F.decode("frame.payload.data", "UTF-8").alias("name"))
