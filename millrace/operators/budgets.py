"""Spend of applications per calendar period, checked against their budgets.

A ledger has ``application, ts, amount``; budgets have one row per application with
``application, monthly_limit, subscribers``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.time import utc_day
from millrace.shared import Folder, materialize

# The percentages of the limit at which each budget alerts.
DEFAULT_RULES = {
    "DAILY": (80, 100),
    "MONTHLY": (90, 95, 99, 100),
    "QUARTERLY": (90, 100),
    "ANNUALLY": (90, 100),
}

COMPARISONS = {
    "AT_LEAST": lambda spend, level: spend >= level,
    "EQUAL_TO": lambda spend, level: spend == level,
    "GREATER_THAN": lambda spend, level: spend > level,
    "LESS_THAN": lambda spend, level: spend < level,
}


def _per_time_unit(value: str, values: Mapping[str, Column]) -> Column:
    return F.explode(
        F.array(
            *(
                F.struct(F.lit(unit).alias("time_unit"), column.alias(value))
                for unit, column in values.items()
            )
        )
    )


def budget_limits(budgets: DataFrame) -> DataFrame:
    """Each application's limit per time unit, from its limit per month of 30 days.

    A negative or fractional limit fails the job, and so does a second one of an application.
    """
    given = F.col("monthly_limit")
    wrong = F.lit("Budget limit must be one whole number from 0 on, application ")
    monthly = (
        F.when(
            (F.col("n") > 1) | (given < 0) | (given != F.floor(given)),
            F.raise_error(F.concat(wrong, F.coalesce("application", F.lit("null")))),
        )
        .otherwise(given)
        .cast("bigint")
    )
    budgets = budgets.groupBy("application").agg(
        F.count("*").alias("n"), F.max("monthly_limit").alias("monthly_limit")
    )
    limits = _per_time_unit(
        "limit_amount",
        {
            "DAILY": F.expr("monthly div 30"),
            "MONTHLY": F.col("monthly"),
            "QUARTERLY": F.col("monthly") * 3,
            "ANNUALLY": F.col("monthly") * 12,
        },
    )
    return (
        budgets.select("application", monthly.alias("monthly"))
        .select("application", limits.alias("limit"))
        .select("application", "limit.*")
    )


def spend_by_period(ledger: DataFrame, amount: str = "amount") -> DataFrame:
    """Sum an amount per application and calendar day, month, quarter and year in UTC.

    Days are summed first, so that only one row per application and day, not the ledger, is
    repeated for the four periods. Both sums combine before they shuffle.
    """
    return _by_period(_daily(ledger, amount))


def _daily(ledger: DataFrame, amount: str) -> DataFrame:
    return (
        ledger.select("application", utc_day(ledger, "ts").alias("day"), amount)
        .groupBy("application", "day")
        .agg(F.sum(amount).alias("spend"))
    )


def add_to_days(
    ledger: DataFrame, path: str, amount: str = "amount", format_: str = "parquet"
) -> None:
    """Add new ledger rows to the day sums kept at ``path``, in a folder per month.

    Only the months that the rows touch are read, summed again and replaced; late rows and
    negative amounts are rows like any other. The new rows are summed first, to a row per
    application and day, and the sums of the months they touch are kept in the shared folder
    before a folder is replaced, so a job that fails while it computes changes nothing. Rows
    without a time have a folder of their own. Each call adds its rows, so rows are given once.
    """
    spark = ledger.sparkSession
    new = _daily(ledger, amount).withColumn("month", F.trunc("day", "month"))
    new = materialize(new)
    # One row per different month.
    months = [row["month"] for row in new.select("month").distinct().collect()]
    if not months:
        return
    if Folder(spark, path).names():
        held = spark.read.schema(new.schema).format(format_).load(path)
        some = F.col("month").isin([m for m in months if m is not None])
        if None in months:
            some = F.coalesce(some, F.lit(True))
        new = new.unionByName(held.filter(some))
        new = new.groupBy("application", "day", "month").agg(F.sum("spend").alias("spend"))
        new = materialize(new.withColumn("spend", F.col("spend").cast(held.schema["spend"].dataType)))
    (
        new.repartition("month")
        .write.format(format_)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .save(path)
    )


def spend_from_days(spark: SparkSession, path: str, format_: str = "parquet") -> DataFrame:
    """:func:`spend_by_period` of all rows that were added to the day sums at ``path``."""
    return _by_period(spark.read.format(format_).load(path).select("application", "day", "spend"))


def _by_period(daily: DataFrame) -> DataFrame:
    """Sum days to all periods; by application, as one has no more rows than days."""
    periods = _per_time_unit(
        "period",
        {
            "DAILY": F.col("day"),
            "MONTHLY": F.trunc("day", "month"),
            "QUARTERLY": F.trunc("day", "quarter"),
            "ANNUALLY": F.trunc("day", "year"),
        },
    )
    return (
        daily.repartition("application")
        .select("application", periods.alias("p"), "spend")
        .groupBy("application", "p.time_unit", "p.period")
        .agg(F.sum("spend").alias("spend"))
    )


def _every_day(daily: DataFrame) -> DataFrame:
    """Days without spend between an application's first and last day, with a spend of zero."""
    span = daily.groupBy("application").agg(
        F.min("day").alias("first"), F.max("day").alias("last"), F.max("spend").alias("any")
    )
    days = span.filter("first is not null").select(
        "application",
        F.explode(F.sequence("first", "last")).alias("day"),
        (F.col("any") * 0).cast(daily.schema["spend"].dataType).alias("spend"),
    )
    return daily.unionByName(days)


def budget_alerts(
    ledger: DataFrame,
    budgets: DataFrame,
    rules: Mapping[str, Sequence[int]] = DEFAULT_RULES,
    comparison: str = "AT_LEAST",
    threshold_type: str = "PERCENTAGE",
    amount: str = "amount",
) -> DataFrame:
    """One row per application, period and threshold that the period's spend has reached.

    ``rules`` maps a time unit to its thresholds: percentages of the limit, or amounts with
    ``threshold_type="ABSOLUTE_VALUE"``. A zero limit alerts only where something was spent.
    Zero is below a threshold and may equal one: with ``LESS_THAN`` and ``EQUAL_TO`` the periods
    without a ledger row count too, from an application's first day in the ledger to its last;
    an application without any day has none.
    The rules are part of the plan and join nothing; limits join on application and time unit,
    and Spark broadcasts them if it finds them small.
    """
    if comparison not in COMPARISONS:
        raise ValueError(f"Unknown comparison {comparison!r}, use one of {sorted(COMPARISONS)}")
    spend, limit, threshold = F.col("spend"), F.col("limit_amount"), F.col("threshold")
    if threshold_type == "PERCENTAGE":
        reached = COMPARISONS[comparison](spend * 100, threshold * limit)
        reached &= (limit > 0) | (spend > 0)
    elif threshold_type == "ABSOLUTE_VALUE":
        reached = COMPARISONS[comparison](spend, threshold)
    else:
        raise ValueError(f"Unknown threshold type {threshold_type!r}")
    if unknown := rules.keys() - DEFAULT_RULES.keys():
        raise ValueError(f"Unknown time unit {sorted(unknown)}, use one of {[*DEFAULT_RULES]}")
    if any(not isinstance(value, int) for values in rules.values() for value in values):
        raise ValueError("Thresholds must be whole numbers")

    thresholds = F.create_map(
        *(
            part
            for unit, values in rules.items()
            for part in (F.lit(unit), F.array(*map(F.lit, values)).cast("array<bigint>"))
        )
    ).cast("map<string,array<bigint>>")
    limits = budget_limits(budgets)
    daily = _daily(ledger, amount)
    if comparison in ("LESS_THAN", "EQUAL_TO"):
        daily = _every_day(daily)
    return (
        _by_period(daily)
        .filter(F.col("time_unit").isin(*rules))
        .join(limits, ["application", "time_unit"])
        .withColumn("threshold", F.explode(thresholds[F.col("time_unit")]))
        .filter(reached)
        .select("application", "time_unit", "period", "threshold", "limit_amount", "spend")
    )


def alert_recipients(alerts: DataFrame, budgets: DataFrame) -> DataFrame:
    """Every alert once per subscriber of its application; no subscribers, no row."""
    subscribers = budgets.select("application", "subscribers")
    return alerts.join(subscribers, "application").select(
        *alerts.columns, F.explode("subscribers").alias("subscriber")
    )
