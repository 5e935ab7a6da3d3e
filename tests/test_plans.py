"""What the plans of the registered queries must look like at any size."""

import re

import pytest

from millrace.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


OF_STORES = ("list_objects", "objects_at", "read_objects", "read_named_objects", "read_object_ranges")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(query(spark, SF_DIR)) for name, query in QUERIES.items()}


@pytest.fixture
def without_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_products_and_no_python(plans):
    for name, text in plans.items():
        if name in OF_STORES:
            text = text.replace("MapInArrow", "")  # lists, looks up or opens the files
        for operator in ("CartesianProduct", "NestedLoop", "Python", "InPandas", "InArrow"):
            assert operator not in text, (name, operator)


def test_joins_do_without_broadcasts(spark, without_broadcasts):
    for name in ("budget_alerts", "alert_recipients", "throttled_requests", "objects_exist"):
        text = plan(QUERIES[name](spark, SF_DIR))
        assert "Broadcast" not in text, name
        assert "SortMergeJoin" in text or "ShuffledHashJoin" in text, name


def scans(text):
    return [
        {re.sub(r"#\d+L?", "", column) for column in columns.split(",")}
        for columns in re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    ]


@pytest.mark.parametrize(
    "name, columns",
    [
        (
            "spend_by_period",
            [{"o_custkey", "o_totalprice", "o_orderdate"}, {"c_custkey", "c_mktsegment"}],
        ),
        ("rate_limit_audit", [{"ts", "user_id"}]),
        ("object_keys", [{"url"}] * 5),
        ("conversation_requests", [{"conv_id", "turn", "role", "text"}]),
    ],
)
def test_scans_read_only_what_is_used(plans, name, columns):
    assert scans(plans[name]) == columns


def test_tag_filter_reaches_the_scan(plans):
    assert "EqualTo(c_mktsegment,BUILDING)" in plans["tag_filter"]


@pytest.mark.parametrize(
    "name, shuffles",
    [
        ("rate_limit_audit", 1),
        ("object_state", 1),
        ("object_keys", 1),
        ("conversation_requests", 1),
        ("budget_limits", 1),
        ("merge_tags", 0),
        ("single_turn_requests", 0),
    ],
)
def test_shuffles(plans, name, shuffles):
    assert plans[name].count("Exchange hashpartitioning") == shuffles


def test_sums_combine_before_every_shuffle(plans):
    for name in ("spend_by_period", "rate_limit_audit", "object_state", "object_keys"):
        lines = [line.strip(" +-:") for line in plans[name].splitlines()]
        for upper, lower in zip(lines, lines[1:]):
            if upper.startswith("Exchange hashpartitioning"):
                # Or the sums of days go to their application's task.
                days = name == "spend_by_period" and "day#" in lower
                assert "partial_" in lower or days, (name, lower)
