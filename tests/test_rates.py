import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import rate_limit_audit, rates, throttled_requests
from millrace.operators.rates import DEFAULT_TIERS
from millrace.shared import materialize

START = dt.datetime(2024, 1, 1)


def make_requests(spark, data):
    return spark.createDataFrame(
        list(data), "request_id bigint, api_key bigint, tier string, ts timestamp_ntz"
    )


def test_limits_of_the_tiers():
    assert DEFAULT_TIERS == {"default": None, "tier-1": 500, "tier-2": 5000, "tier-3": 10000}


def test_audit(spark, rows):
    requests = make_requests(
        spark,
        [
            (1, 1, "one", START),
            (2, 1, "one", START + dt.timedelta(seconds=59.999999)),
            (3, 1, "one", START + dt.timedelta(minutes=1)),
            (4, 2, "default", START),
            (5, 2, "default", START),
            (6, 3, "unheard-of", START),
            (7, 4, None, START),
        ],
    )
    later = START + dt.timedelta(minutes=1)
    assert rows(rate_limit_audit(requests, {"default": None, "one": 1})) == sorted(
        [
            (1, "one", START, 2, 1, True),
            (1, "one", later, 1, 1, False),
            (2, "default", START, 2, None, False),
            (3, "unheard-of", START, 1, None, False),
            (4, None, START, 1, None, False),
        ],
        key=repr,
    )


def test_no_limits_at_all(spark):
    requests = make_requests(spark, [(1, 1, "default", START)])
    assert not rate_limit_audit(requests, {}).first().exceeded
    assert throttled_requests(requests, {"default": None}).count() == 0


def test_ties_count_in_order_of_id(spark, rows):
    requests = make_requests(spark, [(i, 1, "one", START) for i in (5, 3, 4, 1, 2)])
    assert rows(throttled_requests(requests, {"one": 2})) == [(3, 3), (4, 4), (5, 5)]


def test_requests_without_a_key_share_one_limit(spark, rows):
    requests = make_requests(
        spark, [(1, None, "one", START), (2, None, "one", START), (3, 7, "one", START)]
    )
    assert rows(throttled_requests(requests, {"one": 1})) == [(2, 2)]
    assert (None, "one", START, 2, 1, True) in rows(rate_limit_audit(requests, {"one": 1}))


def test_each_window_starts_anew(spark, rows):
    requests = make_requests(
        spark,
        [
            (1, 1, "one", START),
            (2, 1, "one", START + dt.timedelta(seconds=59.999999)),
            (3, 1, "one", START + dt.timedelta(minutes=1)),
        ],
    )
    assert rows(throttled_requests(requests, {"one": 1})) == [(2, 2)]


def brute_force(data, tiers, minutes):
    seen, throttled = defaultdict(int), []
    for request_id, api_key, tier, ts in sorted(data, key=lambda r: (r[3], r[0])):
        window = (ts - START) // dt.timedelta(minutes=minutes)
        seen[api_key, tier, window] += 1
        n, limit = seen[api_key, tier, window], tiers.get(tier)
        if limit is not None and n > limit:
            throttled.append((request_id, n))
    return sorted(throttled, key=repr)


@pytest.mark.parametrize("slice_length", ["1 second", "7 seconds", "1 minute", "1 hour"])
def test_any_slices_give_the_same_numbers(spark, rows, slice_length):
    """Against plain counting, with a key that makes most requests and many equal times."""
    rng = random.Random(slice_length)
    tiers = {"default": None, "low": 3, "high": 40}
    data = [
        (
            i,
            rng.choice([1, 1, 1, 2, 3]),
            rng.choice(["default", "low", "high", "unheard-of"]),
            START + dt.timedelta(seconds=rng.randrange(600)),
        )
        for i in range(3000)
    ]
    rng.shuffle(data)
    result = throttled_requests(make_requests(spark, data), tiers, "5 minutes", slice_length)
    assert rows(result) == brute_force(data, tiers, 5)


def test_only_throttled_requests_are_shuffled(spark, tmp_path):
    """One key of very many exceeds its limit; the table's other columns are left unread."""
    spark.range(200_000).select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("api_key"),
        F.lit("low").alias("tier"),
        (F.timestamp_seconds(F.lit(1704067200)) + F.expr("make_dt_interval(0, 0, 0, id div 4000)"))
        .cast("timestamp_ntz")
        .alias("ts"),
        F.repeat(F.lit("x"), 100).alias("body"),
    ).write.parquet(f"{tmp_path}/requests")
    requests = spark.read.parquet(f"{tmp_path}/requests")
    throttled = throttled_requests(requests, {"low": 66_000, "idle": None})
    assert sorted(r.n for r in throttled.collect()) == list(range(66_001, 66_669))
    plan = throttled._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan


def test_requests_of_one_instant_are_split(spark, monkeypatch):
    """Two thirds of the requests are one key's at one time; no range of them is much larger."""
    kept = []

    def keep(df):
        kept.append(materialize(df))
        return kept[-1]

    monkeypatch.setattr(rates, "materialize", keep)
    hot = F.col("id") % 3 != 0
    requests = spark.range(60_000).select(
        F.col("id").alias("request_id"),
        F.when(hot, 1).otherwise(F.col("id") % 50).alias("api_key"),
        F.lit("low").alias("tier"),
        F.when(hot, F.lit(START)).otherwise(F.lit(START + dt.timedelta(seconds=1))).alias("ts"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        throttled = throttled_requests(requests, {"low": 10})
        numbers = throttled.groupBy(F.col("request_id") % 3 != 0).agg(
            F.count("*").alias("c"), F.max("n").alias("most"), F.countDistinct("n").alias("d")
        )
        hot_row = next(r for r in numbers.collect() if r[0])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (hot_row.c, hot_row.most, hot_row.d) == (39_990, 40_000, 39_990)
    sizes = [r["count"] for r in kept[-1].groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_many_throttled_keys_without_broadcast(spark, rows):
    """With nothing broadcast the result is the same."""
    data = [(i, i % 50, "low", START + dt.timedelta(seconds=i % 90)) for i in range(2000)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = throttled_requests(make_requests(spark, data), {"low": 3})
        assert rows(result) == brute_force(data, {"low": 3}, 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
