"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link every node's larger (or its smaller) neighbours to its smallest one.

    The neighbours of a node are never gathered: their minimum is aggregated, with partial
    sums before the shuffle, and joined back to the edges, which a hot node may split.
    """
    if larger:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(lowest, "a").filter("b > a")
        out = joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(lowest, "a")
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            lowest.select("a", F.col("m").alias("b"))
        )
    return out.filter("a != b").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node reachable from each node of ``links``: columns ``node, component_id``.

    Alternates large and small stars until nothing changes; both take as many rounds as the
    logarithm of the longest path. Each round is written to the shared folder, so a lost
    executor repeats only its tasks of the round. A link of a node to itself or to null adds
    nothing; nodes without a link to another are not in the result.
    """
    edges = links.select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    ).filter(f"{a} is not null and {b} is not null and {a} != {b}")
    edges = materialize(edges.distinct())
    before = None
    while True:
        edges = materialize(_stars(_stars(edges, True), False))
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).collect()[0]
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
        before = state
