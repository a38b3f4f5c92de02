"""Plans that the queries should keep: pruned scans, pushed filters, top-k, partial aggregates, no global window where cut."""

import re

import pytest

from tidemark.flow import Flow
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture
def of(spark):
    return lambda name: plan(catalog.queries()[name](spark, SF))


def test_filters_and_columns_reach_the_scan(of):
    p = of("scan")
    assert re.search(r"PushedFilters: \[.*GreaterThan\(value,50", p) and "props" not in p.split("ReadSchema")[1].split("\n")[0]
    p = of("map_filter")
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in p and "Exchange" not in p and "WholeStageCodegen" not in p.split("==")[0]


def test_take_is_a_top_k(of):
    assert "TakeOrderedAndProject" in of("take") and "WindowGroupLimit" in of("take_by_key")


def test_terminals_combine_before_the_shuffle(of):
    for name in ("terminal_sum_by_key", "terminal_first_by_key", "distinct", "terminal_all"):
        assert re.search(r"partial_", of(name)), name


def test_keyed_operators_shuffle_once(of):
    for name in ("pairwise", "windowed_mean", "debounce", "scan_kinds", "throttle", "credits", "distinct_until_changed", "errors_terminate"):
        tree = of(name).split("\n\n")[0]
        assert len(re.findall(r"\bExchange \(", tree)) == 1, (name, tree)


def test_native_operators_stay_out_of_python(of):
    for name in catalog.queries():
        if not re.search("python|retry|async|parallel|served|compact|cumsum|from_callable|throttle|limit|credits|rate|dynamic|stream|admission", name):
            assert not re.search("InArrow|InPandas|EvalPython|PythonUDF", of(name)), name


def test_cut_order_has_no_window_over_all_rows(spark):
    """The only windows without a key see the table of segments."""
    df = spark.read.parquet(f"{SF}/events.parquet")
    for f in (Flow(df, ("ts", "event_id"), time="ts", wide=True).scan("sum"), Flow(df, ("ts", "event_id"), time="ts", wide=True).pairwise()):
        p = plan(f.df)
        assert "CartesianProduct" not in p
        single = [x for x in p.split("\n\n") if "SinglePartition" in x]
        assert single and "BroadcastHashJoin" in p
