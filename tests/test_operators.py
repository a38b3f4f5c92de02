"""Literal examples of ordered-stream operators, and their edge cases: empty, null, NaN, ties, short inputs."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.flow import Flow, flow
from tidemark.operators import combine, errors, terminals, timing
from tidemark.sources import bounded


def values(f: Flow) -> list:
    return f.to_array()


def one(df):
    return df.first()[0]


@pytest.fixture
def seq(spark):
    return lambda *v, kind="long": bounded.from_values(spark, v, kind)


@pytest.fixture
def timed(spark):
    """(milliseconds, value) pairs as a flow in event time."""

    def make(*pairs, kind="long"):
        start = dt.datetime(2024, 1, 1)
        rows = [(k, start + dt.timedelta(milliseconds=t), v) for k, (t, v) in enumerate(pairs)]
        return Flow(spark.createDataFrame(rows, f"ord long, ts timestamp_ntz, value {kind}"), ("ts", "ord"), time="ts")

    return make


def test_creation(spark):
    assert values(bounded.of(spark, 1, 2, 3, 4, 5)) == [1, 2, 3, 4, 5]
    assert values(bounded.range_(spark, 0, 5)) == [0, 1, 2, 3, 4]
    assert values(bounded.range_(spark, 0, 1, 0.25)) == [0, 0.25, 0.5, 0.75]
    assert values(bounded.range_(spark, 5, 5)) == [] == values(bounded.range_(spark, 6, 5))
    assert values(bounded.empty(spark)) == []
    assert values(bounded.from_callable(spark, lambda: 42, "long")) == [42]
    assert values(bounded.from_values(spark, (x * x for x in range(4)))) == [0, 1, 4, 9]
    assert values(bounded.from_values(spark, [1, None, 2.5])) == [1.0, None, 2.5]
    assert values(bounded.from_vector(spark, [1, 2])) == [[1.0, 2.0]]
    with pytest.raises(ValueError):
        bounded.range_(spark, 0, 5, 0)
    with pytest.raises(ValueError):
        bounded.from_values(spark, [None])


def test_map_filter_take_skip(seq):
    assert values(seq(1, 2, 3).map(lambda v: v * 2)) == [2, 4, 6]
    assert values(seq(1, 2, 3, 4, 5).filter(lambda v: v % 2 == 0)) == [2, 4]
    assert values(seq(1, 2, 3, 4, 5).filter(lambda v: v % 2 == 0).map(lambda v: v * 10)) == [20, 40]
    assert values(seq(1, 2, 3, 4, 5).take(3)) == [1, 2, 3]
    assert values(seq(1, 2, 3, 4, 5).skip(2)) == [3, 4, 5]
    assert values(seq(1, 2).take(0)) == [] == values(seq(1, 2).skip(5)) and values(seq(1, 2).skip(0)) == [1, 2]
    assert values(seq(*range(50)).filter(lambda v: v % 3 != 0).map(lambda v: v * 2)) == [v * 2 for v in range(50) if v % 3]
    assert values(seq(1, None, 3).map(lambda v: v + 1)) == [2, None, 4]
    assert values(seq(1, None, 3).map(lambda v: v + 1, drop_null=True)) == [2, 4]
    assert values(seq(1, None, 3).filter(lambda v: v > 0)) == [1, 3]
    for bad in (-1, 1.5):
        with pytest.raises(ValueError):
            seq(1).take(bad)
    assert values(seq(3, 1, 2).pipe(lambda f: f.skip(1), lambda f: f.map(lambda v: -v))) == [-1, -2]


def test_fork_loses_nothing(seq):
    yes, no = seq(1, 2, 3, 4, 5).fork(lambda v: v % 2 == 0)
    assert (values(yes), values(no)) == ([2, 4], [1, 3, 5])
    yes, no = seq(None, 2, 3, None).fork(lambda v: v % 2 == 0)
    assert (values(yes), values(no)) == ([2], [None, 3, None])


def test_start_with(seq, spark):
    assert values(seq(1, 2, 3).start_with(0, -1)) == [0, -1, 1, 2, 3]
    assert values(seq(1, 2).start_with()) == [1, 2] and values(bounded.empty(spark).start_with(9)) == [9]
    keyed = Flow(spark.createDataFrame([("a", 1, 5), ("b", 1, 6), ("a", 2, 7)], "k string, ord int, value int"), ("ord",), ("k",)).start_with(0)
    assert [tuple(r) for r in keyed.sorted().select("k", "value").collect()] == [("a", 0), ("a", 5), ("a", 7), ("b", 0), ("b", 6)]


def test_scan(seq):
    assert values(seq(1, 2, 3).scan("sum")) == [1, 3, 6]
    assert values(seq(1, 2, 3).scan("sum", 10)) == [11, 13, 16]
    assert values(seq(3, 1, 2).scan("min", 2)) == [2, 1, 1] and values(seq(3, 1, 5).scan("max")) == [3, 3, 5]
    assert values(seq(None, 1, None, 2).scan("last")) == [None, 1, 1, 2]
    assert values(seq(None, 1, None, 2).scan("count")) == [0, 1, 1, 2]
    assert values(seq(1, 2, 3).scan(lambda s, v: s * 10 + v, 0, returns="long")) == [1, 12, 123]
    assert values(seq().scan("sum")) == [] == values(seq().scan(lambda s, v: v, 0, returns="long"))
    with pytest.raises(ValueError):
        seq(1).scan(lambda s, v: s, 0)
    with pytest.raises(ValueError):
        seq(1).scan("median")


def test_pairwise(seq):
    df = seq(1, 2, 3, 4).pairwise().sorted()
    assert [tuple(r) for r in df.select("prev", "cur").collect()] == [(1, 2), (2, 3), (3, 4)]
    df = seq(None, 2, None).pairwise().sorted()
    assert [tuple(r) for r in df.select("prev", "cur").collect()] == [(None, 2), (2, None)]
    assert seq(1).pairwise().df.count() == 0 == seq().pairwise().df.count()


def test_windowed(seq):
    f = seq(1, 2, 3, 4, 5)
    assert values(f.windowed(3, "mean")) == [2, 3, 4] and values(f.windowed(2, "sum")) == [3, 5, 7, 9]
    assert values(f.windowed(2, "max")) == [2, 3, 4, 5] and values(f.windowed(2, "min")) == [1, 2, 3, 4]
    assert values(f.windowed(2, "variance")) == [0.25] * 4 and values(f.windowed(2, "std")) == [0.5] * 4
    assert values(f.windowed(1, "sum")) == [1, 2, 3, 4, 5] and values(f.windowed(6, "sum")) == []
    assert values(f.windowed(2, "sum", step=2)) == [3, 7] and values(f.windowed(2, "collect")) == [[1, 2], [2, 3], [3, 4], [4, 5]]
    for n, op in ((0, "sum"), (-1, "sum"), (2, "median")):
        with pytest.raises(ValueError):
            f.windowed(n, op)


def test_buffer(seq):
    assert values(seq(*range(1, 8)).buffer(3)) == [[1, 2, 3], [4, 5, 6], [7]]
    assert values(seq(1, None, 3).buffer(2)) == [[1, None], [3]]
    assert values(seq(1, 2).buffer(0)) == [[1], [2]] and values(seq().buffer(3)) == []


def test_distinct(seq):
    assert values(seq(1, 1, 2, 2, 3, 3).distinct_until_changed()) == [1, 2, 3]
    assert values(seq(None, None, 1, None, 1, 1).distinct_until_changed()) == [None, 1, None, 1]
    assert [str(v) for v in values(seq(math.nan, math.nan, 0.0, -0.0, kind="double").distinct_until_changed())] == ["nan", "0.0"]
    assert values(seq(3, 1, 3, None, 2, 1, None).distinct()) == [3, 1, None, 2]
    assert values(seq(1, 1, 2, 2, 3, 3).distinct_until_changed().start_with(0)) == [0, 1, 2, 3]


def test_terminals(seq):
    f = seq(1, 2, 3, 4, 5)
    assert [one(x) for x in (f.sum(), f.min(), f.max(), f.mean(), f.count(), f.first(), f.last())] == [15, 1, 5, 3.0, 5, 1, 5]
    assert one(f.find(lambda v: v > 3)) == 4 and one(f.find(lambda v: v > 9)) is None
    assert one(seq(2, 4, 6).all(lambda v: v % 2 == 0)) is True and one(seq(1, 2, 3).some(lambda v: v % 2 == 0)) is True
    assert one(f.reduce("sum", 10)) == 25 and one(f.reduce("max")) == 5
    assert one(f.reduce(lambda s, v: s * 10 + v, 0, "long")) == 12345
    e = seq()
    assert [one(x) for x in (e.sum(), e.min(), e.max(), e.mean(), e.count(), e.first(), e.last())] == [0, None, None, None, 0, None, None]
    assert one(e.all(lambda v: v > 0)) is True and one(e.some(lambda v: v > 0)) is False and one(e.find(lambda v: v > 0)) is None
    assert one(e.reduce("sum", 7)) == 7 and one(e.reduce(lambda s, v: s + v, 7, "long")) == 7
    n = seq(None, 4, None)
    assert one(n.first()) is None and one(n.last()) is None and one(n.count()) == 3 and one(n.all(lambda v: v > 0)) is False
    assert math.isnan(one(seq(1.0, math.nan, 2.0, kind="double").max()))


def test_merge_and_combine(seq, spark, timed):
    assert sorted(values(seq(1, 3, 5).merge(seq(2, 4, 6)))) == [1, 2, 3, 4, 5, 6]
    assert values(timed((10, 1), (30, 3)).merge(timed((5, 2), (35, 4)))) == [2, 1, 3, 4]
    pairs = lambda *fs: [tuple(r)[1:] for r in combine.combine(*fs).sorted().collect()]
    assert pairs(seq("a", "b", kind="string"), seq(1, 2)) == [("a", 1), ("b", 2)]
    assert pairs(seq(1, 2, 3), seq(7)) == [(1, 7), (2, 7), (3, 7)] == [x[::-1] for x in pairs(seq(7), seq(1, 2, 3))]
    assert pairs(seq(1, 2), seq()) == [] == pairs(seq(), seq(1))
    assert pairs(seq(1, None), seq(4, 5, 6)) == [(1, 4), (None, 5), (None, 6)]
    assert pairs(seq(1, 2, 3), seq(4), seq(5, 6)) == [(1, 4, 5), (2, 4, 6), (3, 4, 6)]


def test_latest(timed):
    a, b = timed((10, "a1"), (30, "a2"), kind="string"), timed((20, 1), (40, 2))
    got = combine.combine_latest(a, b).sorted().select("v0", "v1").collect()
    assert [tuple(r) for r in got] == [("a1", 1), ("a2", 1), ("a2", 2)]
    a, b = timed((10, None), (30, 5)), timed((20, None), (40, 2))
    assert [tuple(r) for r in combine.combine_latest(a, b).sorted().select("v0", "v1").collect()] == [(None, None), (5, None), (5, 2)]
    left, right = timed((5, 0), (10, 1), (30, 3), (30, 4)), timed((10, 100), (25, 200))
    assert [tuple(r) for r in combine.with_latest_from(left, right).sorted().select("v0", "v1").collect()] == [(1, 100), (3, 200), (4, 200)]


def test_flattening(seq, timed, spark):
    double = lambda v: F.array(v, v * 10)
    assert values(seq(1, 2, 3).concat_map(double)) == [1, 10, 2, 20, 3, 30]
    first_empty = Flow(spark.createDataFrame([(0, []), (1, [5, 6]), (2, None), (3, [7])], "ord int, value array<long>"), ("ord",))
    assert values(first_empty.concat_map(lambda v: v)) == [5, 6, 7]
    outer = timed((0, 1), (15, 2), (100, 3))
    items = lambda v: F.array(*[F.struct(F.lit(t).cast("long").alias("at_ms"), (v * m).alias("v")) for t, m in ((5, 1), (20, 10))])
    got = combine.switch_items(outer, items)
    assert [r[0] for r in got.sorted().select("item.v").collect()] == [1, 2, 20, 3, 30]
    inner = timed((5, 1), (20, 10), (20, 2), (35, 20), (105, 3), (120, 30)).df.withColumn("g", F.element_at(F.array(*map(F.lit, [1, 1, 2, 2, 3, 3])), (F.col("ord") + 1).cast("int")))
    out = combine.switch_map(outer.of(outer.df.withColumn("g", F.col("value"))), Flow(inner, ("ts", "ord"), time="ts"), ["g"])
    assert [r[0] for r in out.sorted().select("inner_value").collect()] == [1, 2, 20, 3, 30]


def test_debounce_and_throttle(timed):
    assert values(timed((0, 1), (5, 2), (25, 3)).debounce(10)) == [2, 3]
    assert values(timed((0, 1), (10, 2), (19, 3)).debounce(10)) == [1, 3]
    assert values(timed((0, 1), (9, 2), (10, 3), (15, 4), (20, 5)).throttle(10)) == [1, 3, 5]
    assert values(timed((0, 1), (0, 2), (0, 3)).throttle(0)) == [1, 2, 3] and values(timed((0, 1), (0, 2)).throttle(1)) == [1]
    assert values(timed().debounce(5)) == [] == values(timed().throttle(5))
    with pytest.raises(ValueError):
        timed((0, 1)).debounce(-1)


def test_buffer_time(timed):
    assert values(timed((0, 1), (5, 2), (15, 3), (25, 4)).buffer_time(10)) == [[1, 2], [3], [4]]
    assert values(timed((3, 1), (12, 2), (13, 3), (50, 4)).buffer_time(10)) == [[1, 2], [3], [4]]
    assert values(timed().buffer_time(10)) == []


def test_rate_limit(timed):
    f = timing.rate_limit(timed((0, 1), (10, 2), (20, 3), (30, 4), (1500, 5)), 1000, 3)
    assert [r[0] for r in f.sorted().select("accepted").collect()] == [True, True, True, False, True]
    f = timing.rate_limit(timed((0, 1), (1000, 2)), 1000, 1)
    assert [tuple(r) for r in f.sorted().select("accepted", "rate").collect()] == [(True, 1.0), (True, 1.0)]


def test_errors(seq):
    inverse = lambda v: F.try_divide(F.lit(6), 2 - v)
    a = lambda *v: errors.attempt(seq(*v, kind="double"), inverse)
    assert values(a(1, 2, 3, 4).drop()) == [6, -6, -3]
    assert values(a(1, 2, 3).rescue(99.0)) == [6, 99, -6]
    assert values(a(1, 2, 3).terminate()) == [6]
    assert values(a(2, 1).terminate()) == [] and values(a(1, None, 3).drop()) == [6, None, -6]

    def python(v):
        if v == 2:
            raise RuntimeError("two")
        return v * 10

    p = errors.attempt_python(seq(1, 2, 3, 4), python, "long")
    assert values(p.drop()) == [10, 30, 40] and values(p.rescue(99)) == [10, 99, 30, 40] and values(p.terminate()) == [10]
    assert values(p.rescue(lambda e: F.length(e).cast("long"))) == [10, len("RuntimeError: two"), 30, 40]
    assert values(p.rescue(None)) == [10, 30, 40] and values(p.rescue(None, drop_null=False)) == [10, None, 30, 40]
    assert [r["_error"] for r in p.errors().df.collect()] == ["RuntimeError: two"]


def test_async_calls_wait_together_and_keep_their_order(seq):
    """Forty calls of 50 ms with four in flight take ten waits, not forty; results come in the order of the values."""
    import asyncio
    import time

    async def slow(v):
        slow.now = getattr(slow, "now", 0) + 1
        slow.most = max(getattr(slow, "most", 0), slow.now)
        await asyncio.sleep(0.05 if v % 2 else 0.01)
        slow.now -= 1
        if v == 7:
            raise ValueError("seven")
        return v * 1000 + slow.most

    began = time.time()
    out = values(errors.attempt_async(seq(*range(40)), slow, "long", in_flight=4).drop())
    assert [v // 1000 for v in out] == [v for v in range(40) if v != 7] and max(v % 1000 for v in out) <= 4
    assert any(v % 1000 > 1 for v in out) and time.time() - began < 30
    rescued = values(errors.attempt_async(seq(6, 7), slow, "long").rescue(-1))
    assert rescued[1] == -1
    with pytest.raises(ValueError):
        errors.attempt_async(seq(1), slow, "long", in_flight=0)


def test_retries(seq):
    def flaky(v, seen={}):  # noqa: B006
        seen[v] = seen.get(v, 0) + 1
        if seen[v] < 3:
            raise OSError("not yet")
        return v

    assert values(errors.attempt_python(seq(1, 2), flaky, "long", retries=2).drop()) == [1, 2]
    assert values(errors.attempt_python(seq(1, 2), flaky, "long", retries=1).drop()) == []
    waits, calls = [], []

    def action():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert errors.retry(action, 3, 1000, waits.append) == "done" and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        errors.retry(lambda: 1 / 0, 1, 0, waits.append)


def test_sinks(seq, tmp_path, spark):
    from tidemark.sources import sinks

    seen, ended, errs = [], [], []
    assert seq(1, 2, 3).observe(seen.append, on_complete=lambda: ended.append(1)) and seen == [1, 2, 3] and ended == [1]

    def picky(v):
        if v == 2:
            raise ValueError(v)
        seen.append(v)

    seen.clear()
    assert seq(1, 2, 3).observe(picky, errs.append) and seen == [1, 3] and len(errs) == 1
    seen.clear()
    assert not seq(1, 2, 3).observe(picky, errs.append, terminate=True) and seen == [1]

    def stops(v):
        if v > 1:
            raise StopIteration
        seen.append(v)

    seen.clear()
    assert not seq(1, 2, 3).observe(stops) and seen == [1] and list(seq(3, 4)) == [3, 4]
    sinks.to_ndjson(seq(1, 2), f"{tmp_path}/lines")
    back = bounded.from_ndjson(spark, f"{tmp_path}/lines", "ord long, value long", ["ord"])
    assert values(back) == [1, 2]
    sinks.to_parquet(seq(5), f"{tmp_path}/table")
    assert values(bounded.from_parquet(spark, f"{tmp_path}/table", ["ord"])) == [5]


def test_a_flow_checks_its_columns(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        flow(df, "nothing")
    with pytest.raises(ValueError):
        Flow(df, ())
    with pytest.raises(TypeError):
        Flow(df, "id")
    assert flow(df, "id").order == ("id",)


@pytest.mark.parametrize("seed", [1, 2])
def test_cut_order_equals_one_window(spark, seed):
    """All operators without a key: cut into segments and blocks, against one window, ties and nulls included."""
    from tidemark import ordering

    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(40)]), k, rng.choice([None, 1, 2, 3, 4])) for k in range(700)]
    df = spark.createDataFrame(rows, "t int, ord int, value int").repartition(5)
    narrow, wide = (Flow(df, ("t", "ord"), wide=w) for w in (False, True))
    ordering.BLOCK, before = 64, ordering.BLOCK
    try:
        ops = [
            lambda f: f.skip(100),
            lambda f: f.pairwise(),
            lambda f: f.windowed(30, "sum"),
            lambda f: f.windowed(100, "max"),
            lambda f: f.distinct_until_changed(),
            lambda f: f.buffer(33),
            *[lambda f, k=k: f.scan(k) for k in ("sum", "count", "min", "max", "last")],
        ]
        for op in ops:
            a, b = (sorted(map(str, op(f).df.collect())) for f in (narrow, wide))
            assert a == b
    finally:
        ordering.BLOCK = before


@pytest.mark.parametrize("kinds", ["t string, u double, ord int", "t int, u string, ord int", "t date, u timestamp_ntz, ord int"])
def test_segments_follow_the_whole_order(spark, kinds):
    """Strings and ties in the first column are cut too; segments never fall along the order, nulls first."""
    import datetime as dt

    from tidemark.ordering import with_segment

    rng = random.Random(kinds)
    make = {
        "string": lambda: rng.choice([None, "", "a", "é", "zz", "東京", *"bcdefg"]),
        "int": lambda: rng.choice([None, 3, 3, 3, 7]),
        "double": lambda: rng.choice([None, float("nan"), 0.0, -0.0, rng.random()]),
        "date": lambda: dt.date(2024, 1, rng.randrange(1, 4)),
        "timestamp_ntz": lambda: rng.choice([None, dt.datetime(2024, 1, 1, rng.randrange(24), rng.randrange(60))]),
    }
    first, second = (k.split()[1] for k in kinds.split(", ")[:2])
    df = spark.createDataFrame([(make[first](), make[second](), k) for k in range(900)], kinds).repartition(4)
    rows = with_segment(df, ("t", "u", "ord"), 16).orderBy("t", "u", "ord").collect()
    segs = [r["_seg"] for r in rows]
    assert segs == sorted(segs) and len(set(segs)) >= 12 and max(segs.count(x) for x in set(segs)) < 350


def test_cut_time_order_equals_one_window(timed):
    rng, t, pairs = random.Random(3), 0, []
    for k in range(500):
        t += rng.choice([0, 1, 3, 10, 40])
        pairs.append((t, k % 5))
    f = timed(*pairs)
    narrow, wide = (Flow(f.df, f.order, time="ts", wide=w) for w in (False, True))
    for op in (lambda f: f.debounce(10), lambda f: f.throttle(25), lambda f: timing.rate_limit(f, 30, 2)):
        assert sorted(map(str, op(narrow).df.collect())) == sorted(map(str, op(wide).df.collect()))
    last = None
    want = []
    for t, v in pairs:
        if last is None or t - last >= 25:
            want.append(v)
            last = t
    assert values(wide.throttle(25)) == want


def test_grouped_terminals(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, None)], "k string, ord int, value int")
    f = Flow(df, ("ord",), ("k",))
    assert sorted(tuple(r) for r in f.sum().collect()) == [("a", 11), ("b", 0)]
    assert sorted((r[0], r[1]) for r in f.find(lambda v: v > 5).collect()) == [("a", 6), ("b", None)]
    assert sorted(tuple(r) for r in terminals.reduce(f.of(df.na.fill(0)), lambda s, v: s + v, 1, "long").collect()) == [("a", 12), ("b", 1)]


def test_dense_times_are_cut_without_a_gap(spark):
    """Not one gap as long as the step looks back: segments still run side by side, each from the state that it begins with."""
    from tidemark.operators import folds

    rng, t, rows = random.Random(3), 0, [(-1, None), (-2, None)]
    for k in range(5000):
        t += rng.choice([0, 0, 1, 3, 40])
        rows.append((k, dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=t)))
    df = spark.createDataFrame(rows, "id long, ts timestamp").repartition(5)
    for step, added, ms in ((folds.Throttle, {}, 70), (folds.Throttle, {}, 0), (folds.RateLimit, {"ok": "boolean", "rate": "double"}, 90)):
        make = (lambda: step(ms)) if step is folds.Throttle else (lambda: step(ms, 3))
        cut = folds.fold(Flow(df, ("ts", "id"), time="ts", wide=True), make(), added)
        whole = folds.fold(Flow(df, ("ts", "id"), time="ts", wide=False), make(), added)
        assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
        assert "_seg" in plan_of(cut) and "_session" not in plan_of(cut)
        times = np.sort(np.random.default_rng(1).integers(0, 3000, 900))
        state = make().init()
        for x in times.tolist():
            state, _ = make().step(state, {"_ms": x})
        live = lambda s: [x for x in s if x > times[-1] - ms] if isinstance(s, list) else s
        half = make().skim(make().skim(make().init(), times[:400]), times[400:])
        assert live(half) == live(state)


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_tables_of_some_millions_of_rows_are_cut(spark):
    """A rank over 24 MB is not one task's work."""
    df = spark.range(3_000_000).withColumnRenamed("id", "n")
    out = Flow(df, ("n",)).skip(2_999_990).df
    assert "_seg" in plan_of(out) and sorted(r[0] for r in out.collect()) == list(range(2_999_990, 3_000_000))
