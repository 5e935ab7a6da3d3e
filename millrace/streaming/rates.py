from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from millrace.functions.time import utc_instant
from millrace.operators.rates import DEFAULT_TIERS, Tiers, limited_tiers, with_limits


def rate_limit_stream(
    requests: DataFrame,
    tiers: Tiers = DEFAULT_TIERS,
    window: str = "1 minute",
    watermark: str = "10 minutes",
) -> DataFrame:
    """:func:`millrace.operators.rates.rate_limit_audit` over a stream of requests.

    State is one count per key, tier and open window. ``watermark`` is how long a window stays
    open for late requests; later ones are dropped. Write it in update mode with
    :func:`millrace.sinks.write_updates` to see windows as they fill, or in append mode to get
    each window once, after the watermark has passed it. Watermarks need a timestamp with a
    zone; one without is taken as UTC.
    """
    counts = (
        requests.select("api_key", "tier", utc_instant(requests, "ts").alias("ts"))
        .withWatermark("ts", watermark)
        .groupBy(F.window("ts", window), "api_key", "tier")
        .agg(F.count("*").alias("requests"))
        .withColumn("window_start", F.col("window.start"))
    )
    return with_limits(counts, tiers)


def throttle_stream(
    requests: DataFrame,
    tiers: Tiers = DEFAULT_TIERS,
    window: str = "1 minute",
    watermark: str = "10 minutes",
) -> DataFrame:
    """:func:`millrace.operators.rates.throttled_requests` over a stream, as requests come.

    Gives the requests beyond their limit, ``request_id, n``, in append mode. A request's number
    within its key, tier and window is fixed when it comes: those of one micro-batch are numbered
    by ``ts``, then ``request_id``, after those of earlier ones. So a stream in the order of
    ``ts`` gives what the batch gives, also after a restart.

    State is one count per limited key, tier and open window. A window is closed, and its count
    forgotten, when the watermark has passed its end; a request for a closed window is not
    numbered. Only ids and times of tiers with a limit are shuffled; of a micro-batch the
    requests of one key, tier and window are numbered in one task, and bounded by the size of
    the micro-batch.
    """
    limits = limited_tiers(tiers)
    counted = (
        requests.filter(F.col("tier").isin(list(limits)))
        .select("request_id", "api_key", "tier", utc_instant(requests, "ts").alias("ts"))
        .filter("ts is not null")
        .withWatermark("ts", watermark)
        .withColumn("window", F.window("ts", window))
        .select(
            "request_id",
            "api_key",
            "tier",
            "ts",
            F.unix_millis("window.start").alias("starts"),
            F.unix_millis("window.end").alias("ends"),
        )
    )
    number = StructField("n", LongType())
    output = StructType([requests.schema["request_id"], number])

    def throttle(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        _, tier, _, ends = key
        if state.hasTimedOut:
            state.remove()
            return
        if state.getCurrentWatermarkMs() >= ends:
            return
        before = state.get[0] if state.exists else 0
        rows = pd.concat([batch[["request_id", "ts"]] for batch in batches])
        rows = rows.sort_values(["ts", "request_id"], kind="stable")
        numbers = before + 1 + pd.RangeIndex(len(rows))
        state.update((before + len(rows),))
        state.setTimeoutTimestamp(int(ends))
        beyond = numbers > limits[tier]
        yield pd.DataFrame({"request_id": rows["request_id"][beyond], "n": numbers[beyond]})

    return counted.groupBy("api_key", "tier", "starts", "ends").applyInPandasWithState(
        throttle,
        output,
        StructType([number]),
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
