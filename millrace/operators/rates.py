"""Request rates against the limit of a tier.

Requests have ``request_id, api_key, tier, ts``. Tiers map a name to the number of requests one
key may make on that tier per window, a minute unless another is given; ``None`` is no limit,
and neither has a tier that is not listed. The tiers are part of the plan and join nothing.
Requests without a time fall in no window and are not counted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.shared import materialize

# Requests per minute of each tier.
DEFAULT_TIERS = {"default": None, "tier-1": 500, "tier-2": 5000, "tier-3": 10000}

Tiers = Mapping[str, int | None]


def limited_tiers(tiers: Tiers) -> dict[str, int]:
    """The tiers that have a limit."""
    return {tier: limit for tier, limit in tiers.items() if limit is not None}


def limit_of(tier: str, tiers: Tiers) -> Column:
    """The limit of the tier in a column, null where it has none."""
    limits = [F.lit(part) for entry in limited_tiers(tiers).items() for part in entry]
    if not limits:
        return F.lit(None).cast("int")
    return F.try_element_at(F.create_map(*limits), F.col(tier)).cast("int")


def with_limits(counts: DataFrame, tiers: Tiers) -> DataFrame:
    """Counted requests with their tier's limit and whether they exceed it."""
    limited = counts.withColumn("limit_per_minute", limit_of("tier", tiers))
    exceeded = F.coalesce(F.col("requests") > F.col("limit_per_minute"), F.lit(False))
    return limited.select(
        "api_key",
        "tier",
        "window_start",
        "requests",
        "limit_per_minute",
        exceeded.alias("exceeded"),
    )


def rate_limit_audit(
    requests: DataFrame, tiers: Tiers = DEFAULT_TIERS, window: str = "1 minute"
) -> DataFrame:
    """Count the requests of every key, tier and window and compare with the tier's limit.

    Counts combine before the shuffle, so a busy key sends one row per window and task.
    """
    counts = (
        requests.select("api_key", "tier", F.window("ts", window).start.alias("window_start"))
        .groupBy("api_key", "tier", "window_start")
        .agg(F.count("*").alias("requests"))
    )
    return with_limits(counts, tiers)


def throttled_requests(
    requests: DataFrame,
    tiers: Tiers = DEFAULT_TIERS,
    window: str = "1 minute",
    slice_length: str = "10 seconds",
) -> DataFrame:
    """The requests beyond their limit, with their number ``n`` within key, tier and window.

    Requests count in the order of ``ts``, then ``request_id``. Numbering a busy key's whole
    window in one task is avoided: windows are cut into slices, slices are counted with
    a combined aggregation, and a running sum gives each slice its offset. Only the requests
    of slices that end beyond the limit are numbered. These are sorted over the cluster, which
    splits a slice wherever a range ends, also among equal times; a second running sum, over
    the ranges of a slice, gives each range its offset. Any ``slice_length`` gives the same
    result.

    The call itself counts, and keeps the slices beyond the limit in the shared folder. Their
    size is then known when the rest is planned: if few keys exceed their limit, the slices
    are broadcast and only requests beyond it are shuffled; if many do, both sides are.
    """
    group = ["key", "tier", "window_start"]
    limited = (
        requests.filter(F.col("tier").isin(list(limited_tiers(tiers))))
        .select(
            "request_id",
            F.struct("api_key").alias("key"),  # never null, so that a missing key joins too
            "tier",
            "ts",
            F.window("ts", window).start.alias("window_start"),
        )
        .withColumn("slice", F.window("ts", slice_length).start)
    )
    earlier = (
        Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    beyond = materialize(
        limited.groupBy(*group, "slice")
        .agg(F.count("*").alias("requests"))
        .withColumn("before", F.coalesce(F.sum("requests").over(earlier), F.lit(0)))
        .filter(F.col("before") + F.col("requests") > limit_of("tier", tiers))
        .select(*group, "slice", "before")
    )
    ranges = materialize(
        limited.join(beyond, [*group, "slice"])
        .repartitionByRange(*group, "slice", "ts", "request_id")
        .sortWithinPartitions(*group, "slice", "ts", "request_id")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.spark_partition_id())
    )
    # Numbers of a partition follow each other, so a request's number in its range is the way
    # from the first one there: the requests are not shuffled or sorted a second time.
    range_of = [*group, "slice", "part"]
    before = (
        Window.partitionBy(*group, "slice")
        .orderBy("part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranges.groupBy(*range_of)
        .agg(F.count("*").alias("requests"), F.min("at").alias("first"))
        .withColumn("earlier", F.coalesce(F.sum("requests").over(before), F.lit(0)))
        .drop("requests")
    )
    number = F.col("before") + F.col("earlier") + F.col("at") - F.col("first") + 1
    return (
        ranges.join(offsets, range_of)
        .withColumn("n", number)
        .filter(F.col("n") > limit_of("tier", tiers))
        .select("request_id", "n")
    )
