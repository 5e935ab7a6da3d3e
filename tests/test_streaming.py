import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import rate_limit_audit, throttled_requests
from millrace.sinks import read_updates, write_updates
from millrace.streaming import rate_limit_stream, throttle_stream

SCHEMA = "request_id bigint, api_key bigint, tier string, ts timestamp_ntz"
START = dt.datetime(2024, 1, 1)
TIERS = {"default": None, "low": 2}
KEYS = ["api_key", "tier", "window_start"]


def minutes(*values):
    return [START + dt.timedelta(minutes=v) for v in values]


class Log:
    """Requests that arrive one file after the other."""

    def __init__(self, spark, path):
        self.spark, self.path, self.arrived = spark, path, 0

    def add(self, *times, api_key=1, tier="low"):
        rows = [(self.arrived * 1000 + i, api_key, tier, ts) for i, ts in enumerate(times)]
        self.arrived += 1
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{self.path}/topic"
        )

    def stream(self):
        reader = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
        return reader.parquet(f"{self.path}/topic")

    def batch(self):
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/topic")

    def updates(self, watermark):
        write_updates(
            rate_limit_stream(self.stream(), TIERS, "1 minute", watermark),
            f"{self.path}/out",
            f"{self.path}/checkpoint",
        ).awaitTermination()
        return read_updates(self.spark, f"{self.path}/out", KEYS)


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, tmp_path)


def in_utc(df):
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def test_updates_equal_the_batch(spark, rows, log):
    log.add(*minutes(0, 0.1, 0.5, 1))
    log.add(*minutes(0.2, 1.5, 2))
    first = in_utc(log.updates("1 hour"))
    assert rows(first) == rows(rate_limit_audit(log.batch(), TIERS))
    log.add(*minutes(0.3, 3), tier="default")
    log.add(*minutes(0.4, 2.5))
    again = in_utc(log.updates("1 hour"))
    assert rows(again) == rows(rate_limit_audit(log.batch(), TIERS))
    assert (1, "low", START, 5, 2, True) in rows(again)


def test_late_requests_are_dropped(rows, log):
    log.add(*minutes(0, 0.1))
    log.add(*minutes(30))
    log.add(*minutes(31))
    log.add(*minutes(0.2, 32))
    counts = rows(in_utc(log.updates("10 minutes")), "window_start", "requests")
    assert counts == sorted(
        [(START, 2), *((ts, 1) for ts in minutes(30, 31, 32))], key=repr
    )


def test_append_gives_closed_windows_once(spark, rows, log, tmp_path):
    log.add(*minutes(0, 0.1, 0.2))
    log.add(*minutes(30))
    query = (
        rate_limit_stream(log.stream(), TIERS, "1 minute", "10 minutes")
        .writeStream.outputMode("append")
        .option("checkpointLocation", f"{tmp_path}/append")
        .trigger(availableNow=True)
        .start(f"{tmp_path}/closed", format="parquet")
    )
    query.awaitTermination()
    closed = in_utc(spark.read.parquet(f"{tmp_path}/closed"))
    assert rows(closed) == [(1, "low", START, 3, 2, True)]


def test_replayed_batch_replaces_itself(spark, rows, log, tmp_path):
    """Without its checkpoint's commits a batch runs again, and leaves the same rows."""
    log.add(*minutes(0, 0.1))
    before = rows(log.updates("1 hour"))
    write_updates(
        rate_limit_stream(log.stream(), TIERS, "1 minute", "1 hour"),
        f"{tmp_path}/out",
        f"{tmp_path}/other-checkpoint",
    ).awaitTermination()
    assert rows(read_updates(spark, f"{tmp_path}/out", KEYS)) == before
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_without_a_zone_are_utc(spark, log, zone):
    given = spark.conf.get("spark.sql.session.timeZone")
    log.add(*minutes(0))
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        updates = log.updates("1 hour")
        assert updates.select(F.unix_seconds("window_start")).first()[0] == int(
            START.replace(tzinfo=dt.timezone.utc).timestamp()
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", given)


def test_an_empty_stream_has_no_rows(spark, rows, log):
    log.add()
    assert rows(log.updates("1 hour")) == []
    assert log.updates("1 hour").columns == [*KEYS, "requests", "limit_per_minute", "exceeded"]
    with pytest.raises(FileNotFoundError):
        read_updates(spark, f"{log.path}/nowhere", KEYS)


def test_a_new_checkpoint_starts_the_table_anew(spark, rows, log):
    """The first query's batches are more and have higher numbers, but are another query's."""
    for k in range(4):
        log.add(*minutes(0, 0.1))
    log.updates("1 hour")
    log.add(*minutes(0.2, 5))
    stream = log.stream().filter("request_id % 1000 = 0")
    write_updates(
        rate_limit_stream(stream, TIERS, "1 minute", "1 hour"), f"{log.path}/out", f"{log.path}/new"
    ).awaitTermination()
    found = read_updates(spark, f"{log.path}/out", KEYS)
    assert rows(in_utc(found), "window_start", "requests") == [(START, 5)]
    assert len([p for p in (log.path / "out").iterdir() if p.name.startswith("query=")]) == 1


def folders(log):
    return sorted(
        int(p.name.split("=")[1]) for p in (log.path / "out").glob("query=*/batch_id=*")
    )


def snapshots(log, every=4):
    query = write_updates(
        rate_limit_stream(log.stream(), TIERS, "1 minute", "1 hour"),
        f"{log.path}/out",
        f"{log.path}/checkpoint",
        keys=KEYS,
        snapshot_every=every,
    )
    query.awaitTermination()
    return read_updates(log.spark, f"{log.path}/out", KEYS)


def test_snapshots_keep_reading_flat(spark, rows, log):
    for k in range(11):
        log.add(*minutes(0, k), api_key=k % 3)
    found = snapshots(log)
    assert rows(in_utc(found)) == rows(rate_limit_audit(log.batch(), TIERS))
    held = folders(log)
    assert max(held) >= 10 and min(held) >= 7 and len(held) <= 5
    for k in range(6):
        log.add(*minutes(1, 20 + k), api_key=k)
        found = snapshots(log)
        assert rows(in_utc(found)) == rows(rate_limit_audit(log.batch(), TIERS))
        assert len(folders(log)) <= 2 * 4


def test_a_replayed_snapshot_loses_nothing(spark, rows, log):
    """The job breaks off when a snapshot is written and its batch isn't committed yet."""
    for k in range(4):
        log.add(*minutes(0, k))
    before = rows(snapshots(log))
    commits = log.path / "checkpoint" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    (log.path / "undone").mkdir()
    for name in (f"{last}", f".{last}.crc"):
        if (commits / name).exists():
            (commits / name).rename(log.path / "undone" / name)
    assert 3 in folders(log) and rows(snapshots(log)) == before


REQUESTS = "request_id long, api_key long, tier string, ts timestamp_ntz"


def throttled_as_they_come(spark, folder, tiers, watermark="10 minutes"):
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1)
    query = (
        throttle_stream(stream.parquet(f"{folder}/topic"), tiers, "1 minute", watermark)
        .writeStream.option("checkpointLocation", f"{folder}/throttled-checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/throttled", format="parquet")
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/throttled")


def test_throttling_as_requests_come(spark, rows, tmp_path):
    """Ordered requests, a file at a time, with a restart: what the batch gives."""
    rng = random.Random(4)
    tiers = {"default": None, "low": 3, "high": 20}
    data = [
        (
            k,
            rng.choice([1, 1, 1, 2, None]),
            rng.choice(["default", "low", "high", "unheard-of", None]),
            START + dt.timedelta(seconds=k // 5),
        )
        for k in range(1_500)
    ]
    for part in range(4):
        some = data[part * 375 : (part + 1) * 375]
        spark.createDataFrame(some, REQUESTS).coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/topic"
        )
        found = throttled_as_they_come(spark, tmp_path, tiers)
    expected = throttled_requests(spark.createDataFrame(data, REQUESTS), tiers)
    assert rows(found, "request_id", "n") == rows(expected, "request_id", "n")
    assert found.count() > 300


def test_requests_for_closed_windows_are_not_numbered(spark, rows, tmp_path):
    for at in (0, 60, 61, 0.5, 61.2):
        times = [(k + int(at * 100), 1, "low", START + dt.timedelta(minutes=at)) for k in range(3)]
        spark.createDataFrame(times, REQUESTS).coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/topic"
        )
        found = throttled_as_they_come(spark, tmp_path, {"low": 2})
    assert rows(found) == sorted([(2, 3), (6002, 3), (6102, 3), *((6120 + k, 4 + k) for k in range(3))])
