"""Numeric kernels, flow control, frames and the work queue on literal inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import flowcontrol, frames, service
from tidemark.flow import Flow
from tidemark.functions import kernels
from tidemark.sources import bounded


@pytest.fixture
def vec(spark):
    def run(fn, *vectors, kind="float"):
        names = [f"v{k}" for k in range(len(vectors))]
        df = spark.createDataFrame([tuple([float(x) for x in v] if v is not None else None for v in vectors)], ", ".join(f"{n} array<{kind}>" for n in names))
        return df.select(fn(*map(F.col, names)).alias("r")).first()["r"]

    return run


def test_kernels(vec):
    k = kernels.map_kernel
    assert vec(lambda a: k("square", a), [1, 2, 3]) == [1, 4, 9]
    assert vec(lambda a: k("mul_add", a, factor=2, addend=1.5), [1, 2, 3, 4, 5]) == [3.5, 5.5, 7.5, 9.5, 11.5]
    root = vec(lambda a: k("sqrt", a), [4, -1])
    assert root[0] == 2 and math.isnan(root[1])
    assert vec(lambda a: k("cumsum", a), [1, 2, 3]) == [1, 3, 6] == vec(lambda a: k("cumsum", a, engine="arrow"), [1, 2, 3])
    z = vec(lambda a: k("normalize", a), [1, 2, 3, 4])
    assert np.allclose(z, (np.arange(1, 5) - 2.5) / np.std([1, 2, 3, 4]), atol=1e-6)
    assert all(math.isnan(x) for x in vec(lambda a: k("normalize", a), [5, 5, 5]) + vec(lambda a: k("normalize", a), [5]))
    assert vec(lambda a: k("rolling_mean", a, n=2), [1, 3, 5]) == [2, 4] == vec(lambda a: k("rolling_mean", a, n=2, engine="arrow"), [1, 3, 5])
    assert vec(lambda a: k("rolling_mean", a, n=4), [1, 2]) == [] == vec(lambda a: k("rolling_mean", a, n=4, engine="arrow"), [1, 2])
    assert vec(lambda a, b: k("dot", a, b), [1, 2, 3], [4, 5, 6]) == 32 and vec(lambda a, b: k("vector_add", a, b), [1, 2], [3, 4]) == [4, 6]
    assert tuple(vec(lambda a: k("min_max", a), [3, 1, 2])) == (1, 3) and tuple(vec(lambda a: k("min_max", a), [])) == (0, 0)
    for name in ("square", "sqrt", "cumsum", "normalize"):
        assert vec(lambda a, n=name: k(n, a), []) == []
        assert vec(lambda a, n=name: k(n, a), None) is None
    with pytest.raises(ValueError):
        kernels.map_kernel("fft", F.col("a"))
    with pytest.raises(ValueError):
        kernels.rolling_mean(F.col("a"), 0)
    for pair in (lambda a, b: k("dot", a, b), lambda a, b: k("vector_add", a, b)):
        with pytest.raises(Exception, match="differ in length"):
            vec(pair, [1, 2], [1])


def test_float_stays_float(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "a array<float>")
    for name, more in (("square", {}), ("sqrt", {}), ("mul_add", {"factor": 2, "addend": 1}), ("cumsum", {}), ("normalize", {}), ("rolling_mean", {"n": 1})):
        assert df.select(kernels.map_kernel(name, F.col("a"), **more).alias("r")).dtypes[0][1] == "array<float>"


def test_credits():
    c = flowcontrol.CreditController(5)
    assert c.consume(2) and c.available == 3 and not c.consume(4) and c.available == 3
    c.add(10)
    assert c.available == 13 and not c.exhausted
    c.reset()
    assert c.available == 5 and c.consume(5) and c.exhausted
    c.add(1 << 60)
    assert c.available == flowcontrol.MOST_CREDITS
    m = flowcontrol.StreamCredits(3)
    m.register("s1")
    m.register("s2", 10)
    assert (m.available("s1"), m.available("s2"), m.total()) == (3, 10, 13)
    assert m.consume("s1", 2) and m.available("s1") == 1
    m.add("s1", 5)
    m.unregister("s2")
    assert m.available("s1") == 6 and m.streams() == ["s1"] and not m.consume("s2", 1) and m.exhausted("s2") and m.available("s2") is None


def test_credit_calls(spark):
    rows = [("s1", 0, "take", 2), ("s1", 1, "take", 4), ("s1", 2, "add", 10), ("s1", 3, "reset", None), ("s2", 0, "take", 5)]
    f = Flow(spark.createDataFrame(rows, "stream string, step int, op string, amount int"), ("step",), ("stream",))
    got = [tuple(r) for r in flowcontrol.credit_calls(f, 5).sorted().select("stream", "granted", "left").collect()]
    assert got == [("s1", True, 3), ("s1", False, 3), ("s1", None, 13), ("s1", None, 5), ("s2", True, 0)]


def test_adaptive_and_limits(spark):
    a = flowcontrol.AdaptiveBackpressure(100, 50, 10, 1000)
    a.update(10)
    up = a.rate
    a.update(500)
    assert up > 100 and 10 <= a.rate <= 1000 and a.delay_ms > 0 and a.should_throttle(1e9)
    f = bounded.from_values(spark, [10.0, 500.0])
    got = [r["rate"] for r in flowcontrol.adaptive_rates(f, 100, 50, 10, 1000).sorted().collect()]
    assert got == [up, a.rate]
    w = flowcontrol.WindowedRateLimiter(1000, 3)
    assert [w.try_acquire(t) for t in (0, 10, 20, 30, 1500)] == [True, True, True, False, True]
    assert w.rate(1500) == 1.0 and w.slots(1500) == 2
    d = flowcontrol.DynamicBackpressure(10, 50)
    m = flowcontrol.Metrics
    decisions = [d.should_accept(x) for x in (m(5, 100, 60, 40, 100), m(5, 100, 60, 200, 100), m(20, 100, 60, 40, 100), m(5, 100, 101, 40, 100))]
    assert decisions == [True, False, False, False]


def test_frames_round_trip(spark):
    rows = [(1, b"\x00\xff ", [1.5, -2.0], "x"), (2, b"", [], "y\"\n"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "id long, data binary, floats array<float>, text string")
    kinds = {
        "data": frames.data_payload(F.col("data")),
        "float32": frames.float_payload(F.col("floats")),
        "error": frames.error_payload(F.lit(500), F.col("text"), F.lit(True)),
        "control": frames.control_payload(frames.message("credit", amount=F.lit(7))),
    }
    for kind, payload in kinds.items():
        made = df.withColumn("f", frames.frame(payload, F.col("id"), F.lit(1700000000000)))
        back = made.withColumn("b", frames.decode(frames.encode(F.col("f"))))
        assert all(r["f"] == r["b"] for r in back.collect()), kind
        compact = made.withColumn("c", frames.encode_compact(F.col("f"))).withColumn("b", frames.decode_compact(F.col("c")))
        assert all(r["f"] == r["b"] and r["c"][0] == 1 for r in compact.collect()), kind
        assert compact.filter(F.octet_length("c") < F.octet_length(frames.encode(F.col("f")))).count() == 3, kind
        assert back.filter(frames.is_type(F.col("b"), kind)).count() == 3
    junk = spark.createDataFrame([(b"no frame",), (b"{}",), (None,)], "raw binary")
    assert [r[0] for r in junk.select(frames.decode(F.col("raw"))).collect()] == [None] * 3
    assert [r[0] for r in junk.select(frames.decode_compact(F.col("raw"))).collect()] == [None] * 3
    broken = spark.createDataFrame([(b"\x01" + bytes(5),), (b"\x01" + bytes(16) + b"\x03\x01",), (b"\x01" + bytes(16) + b"\x09",)], "raw binary")
    assert [r[0] for r in broken.select(frames.decode_compact(F.col("raw"))).collect()] == [None] * 3
    timeless = df.withColumn("f", frames.frame(kinds["data"], F.col("id"), F.lit(None)))  # the compact form has no room for it: JSON
    both = timeless.withColumn("c", frames.encode_compact(F.col("f"))).withColumn("b", frames.decode_compact(F.col("c")))
    assert all(r["c"][:1] == b"{" and r["f"] == r["b"] for r in both.collect())
    with pytest.raises(ValueError):
        frames.message("shout")
    f = bounded.from_values(spark, ["a", "b", "c"])
    numbers = frames.numbered(f, frames.data_payload(F.col("value").cast("binary")), F.lit(0)).sorted().select("frame.sequence").collect()
    assert [r[0] for r in numbers] == [0, 1, 2]
    for kind, extra in (("ack", {"sequence": F.lit(1)}), ("subscribe", {"stream": F.lit("s")}), ("pause", {}), ("resume", {}), ("complete", {}), ("unsubscribe", {"stream": F.lit("s")})):
        assert spark.range(1).select(frames.message(kind, **extra).alias("m")).first()["m"]["type"] == kind


@pytest.mark.parametrize("size", [1, 7, 50, 100, 101, 1000])
def test_chunks(spark, size):
    data = [bytes(range(100)), b"", b"x", None, bytes(1001)]
    df = spark.createDataFrame(list(enumerate(data)), "id int, raw binary")
    cut = frames.chunked(df, "raw", ["id"], size)
    sizes = {i: [] for i in range(5)}
    for r in cut.orderBy("id", "sequence").collect():
        sizes[r["id"]].append(len(r["chunk"]))
    assert all(s == [size] * (len(d or b"") // size) + ([len(d) % size] if len(d or b"") % size else []) for s, d in zip(sizes.values(), data))
    whole = {}
    for r in frames.joined(cut, ["id"]).orderBy("id", "piece").collect():
        whole[r["id"]] = whole.get(r["id"], b"") + r["data"]
        assert len(r["data"]) <= 10 * size
    assert whole == {i: d for i, d in enumerate(data) if d}


def test_queue(spark):
    items = [(f"r{k:02d}", f"p{k}", "queued", k, k, k % 3) for k in range(14)] + [("done", "x", "completed", 0, 100, 0), ("bad", "x", "failed", 0, 0, 3)]
    queue = spark.createDataFrame(items, service.ITEM)
    after = service.processed(queue, F.col("requestId") != "r02", 500)
    got = {r["requestId"]: (r["status"], r["updatedAt"], r["retries"]) for r in after.collect()}
    assert sum(s == "completed" and t == 500 for s, t, _ in got.values()) == 9
    assert got["r02"] == ("failed", 500, 3) and got["r10"] == ("queued", 10, 1) and got["done"][1] == 100
    again = service.processed(queue.filter("requestId = 'r00'"), F.lit(False), 9)
    assert [tuple(r)[2:] for r in again.collect()] == [("queued", 0, 9, 1)]
    assert service.purged(after, 100 + service.KEEP_MS).filter("requestId = 'done'").count() == 0
    assert service.purged(after, 99 + service.KEEP_MS).filter("requestId = 'done'").count() == 1
    assert {r["status"]: r["items"] for r in service.status(queue).collect()} == {"queued": 14, "completed": 1, "failed": 1}
    assert service.history(queue, "r03").count() == 1 and service.history(queue, limit=5).count() == 5
    assert service.item_status(queue, "bad").first()["status"] == "failed"
    told = service.result_frames(queue, after, 500)
    assert told.filter("frame.payload.type = 'data'").count() == 9 and told.filter("frame.payload.type = 'error'").count() == 1
    assert not told.filter("frame.payload.type = 'error'").first()["frame"]["payload"]["recoverable"]
    sent = service.broadcast(spark.range(5).select(F.col("id").alias("sequence")), spark.createDataFrame([("a", 2), ("b", 0), ("c", 9)], "stream string, credits int"))
    assert sorted((r["stream"], r["sequence"]) for r in sent.collect()) == [("a", 0), ("a", 1), *[("c", k) for k in range(5)]]


def test_admission(spark):
    f = Flow(spark.createDataFrame([(k, k * 10) for k in range(1005)], "id int, at long"), ("at", "id"), time="at", value="id")
    got = service.admit(f)
    assert got.df.filter("accepted").count() == 1000
    asked = service.enqueued(f.df, "id", "at", F.col("at"))
    assert asked.columns == [c.split()[0] for c in service.ITEM.split(", ")] and asked.filter("status <> 'queued'").count() == 0


def test_normalize_is_linear_in_the_vector(spark):
    """Mean and deviation are computed once a vector: in the lambda of each element, these vectors would take 10^13 steps."""
    df = spark.range(3, numPartitions=1).select("id", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: (x % 7 + F.col("id")).cast("float")).alias("a"))
    a = np.array([x % 7 for x in range(1, 20_001)], float)
    for r in df.select(kernels.normalize(F.col("a")).alias("r")).collect():
        assert np.allclose(r["r"], (a - a.mean()) / a.std(), atol=1e-6)
