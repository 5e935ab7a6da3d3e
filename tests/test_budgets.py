import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.operators import (
    add_to_days,
    alert_recipients,
    budget_alerts,
    budget_limits,
    spend_by_period,
    spend_from_days,
)


def make_ledger(spark, *entries):
    data = [(app, dt.datetime.fromisoformat(ts), Decimal(amount)) for app, ts, amount in entries]
    return spark.createDataFrame(
        data, "application string, ts timestamp_ntz, amount decimal(18,2)"
    )


def make_budgets(spark, *budgets):
    return spark.createDataFrame(
        list(budgets), "application string, monthly_limit int, subscribers array<string>"
    )


def test_limits_follow_from_the_month(spark, rows):
    budgets = make_budgets(spark, ("a", 100, []), ("b", 29, []), ("c", 30, []), ("d", 0, []))
    limits = {
        (app, unit): limit for app, unit, limit in rows(budget_limits(budgets))
    }
    assert [limits["a", u] for u in ("DAILY", "MONTHLY", "QUARTERLY", "ANNUALLY")] == [
        3,
        100,
        300,
        1200,
    ]
    assert limits["b", "DAILY"] == 0
    assert limits["c", "DAILY"] == 1
    assert limits["d", "ANNUALLY"] == 0


def test_large_limits_do_not_overflow(spark, rows):
    limits = rows(budget_limits(make_budgets(spark, ("a", 2**31 - 1, []))), "limit_amount")
    assert ((2**31 - 1) * 12,) in limits


def test_negative_limit_is_rejected(spark):
    with pytest.raises(PySparkException, match="one whole number from 0 on, application a"):
        budget_limits(make_budgets(spark, ("a", -1, []))).collect()


def test_doubled_and_fractional_limits_are_rejected(spark):
    doubled = make_budgets(spark, ("a", 100, []), ("b", 1, []), ("a", 100, []))
    with pytest.raises(PySparkException, match="one whole number from 0 on, application a"):
        budget_limits(doubled).collect()
    half = spark.createDataFrame([("a", 99.9)], "application string, monthly_limit double")
    with pytest.raises(PySparkException, match="one whole number"):
        budget_limits(half).collect()


def test_no_rules_no_alerts(spark):
    ledger = make_ledger(spark, ("a", "2024-01-01T00:00:00", "100"))
    assert budget_alerts(ledger, make_budgets(spark, ("a", 1, [])), rules={}).collect() == []


def test_days_without_spend_are_below(spark, rows):
    ledger = make_ledger(
        spark, ("a", "2024-01-01T00:00:00", "100"), ("a", "2024-01-03T00:00:00", "100")
    )
    budgets = make_budgets(spark, ("a", 100, []), ("b", 100, []))
    below = budget_alerts(
        ledger, budgets, {"DAILY": (1,)}, comparison="LESS_THAN", threshold_type="ABSOLUTE_VALUE"
    )
    assert [(r.application, str(r.period), r.spend) for r in below.collect()] == [
        ("a", "2024-01-02", 0)
    ]


def test_spend_in_calendar_periods(spark, rows):
    ledger = make_ledger(
        spark,
        ("a", "2024-03-31T23:59:59.999999", "1.10"),
        ("a", "2024-04-01T00:00:00", "2.20"),
        ("a", "2024-04-01T12:00:00", "3.30"),
        ("b", "2024-12-31T00:00:00", "5.00"),
    )
    assert rows(spend_by_period(ledger).filter("application = 'a'")) == sorted(
        [
            ("a", "DAILY", dt.date(2024, 3, 31), Decimal("1.10")),
            ("a", "DAILY", dt.date(2024, 4, 1), Decimal("5.50")),
            ("a", "MONTHLY", dt.date(2024, 3, 1), Decimal("1.10")),
            ("a", "MONTHLY", dt.date(2024, 4, 1), Decimal("5.50")),
            ("a", "QUARTERLY", dt.date(2024, 1, 1), Decimal("1.10")),
            ("a", "QUARTERLY", dt.date(2024, 4, 1), Decimal("5.50")),
            ("a", "ANNUALLY", dt.date(2024, 1, 1), Decimal("6.60")),
        ],
        key=repr,
    )


def test_periods_are_utc_in_any_session_zone(spark, rows):
    """A timestamp with a zone falls on its UTC day, also before 1970."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ledger = spark.sql(
            "SELECT 'a' AS application, ts, 1 AS amount FROM VALUES "
            "(timestamp'2024-04-01 02:00:00Z'), (timestamp'2024-03-31 23:00:00Z'),"
            "(timestamp'1969-12-31 22:00:00Z') AS t(ts)"
        )
        daily = spend_by_period(ledger).filter("time_unit = 'DAILY'")
        assert rows(daily, "period") == [
            (dt.date(1969, 12, 31),),
            (dt.date(2024, 3, 31),),
            (dt.date(2024, 4, 1),),
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_usage_quantity_instead_of_amount(spark, rows):
    ledger = make_ledger(spark, ("a", "2024-01-01T00:00:00", "9")).withColumn("hours", F.lit(7))
    assert {r[0] for r in rows(spend_by_period(ledger, "hours"), "spend")} == {7}


def alerts(df, unit="MONTHLY"):
    return sorted((r.application, r.threshold) for r in df.collect() if r.time_unit == unit)


def test_alert_exactly_at_threshold(spark):
    ledger = make_ledger(
        spark,
        ("at", "2024-01-01T00:00:00", "95.00"),
        ("below", "2024-01-01T00:00:00", "94.99"),
        ("unbudgeted", "2024-01-01T00:00:00", "1000"),
    )
    budgets = make_budgets(spark, ("at", 100, []), ("below", 100, []))
    result = budget_alerts(ledger, budgets)
    assert alerts(result) == [("at", 90), ("at", 95), ("below", 90)]
    assert alerts(result, "DAILY") == [("at", 80), ("at", 100), ("below", 80), ("below", 100)]
    assert alerts(result, "QUARTERLY") == []


@pytest.mark.parametrize(
    "comparison, expected",
    [
        ("AT_LEAST", [("a", 90), ("a", 95)]),
        ("EQUAL_TO", [("a", 95)]),
        ("GREATER_THAN", [("a", 90)]),
        ("LESS_THAN", [("a", 99), ("a", 100)]),
    ],
)
def test_comparisons(spark, comparison, expected):
    ledger = make_ledger(spark, ("a", "2024-01-01T00:00:00", "95.00"))
    budgets = make_budgets(spark, ("a", 100, []))
    assert alerts(budget_alerts(ledger, budgets, comparison=comparison)) == expected


def test_absolute_thresholds(spark):
    ledger = make_ledger(spark, ("a", "2024-01-01T00:00:00", "95.00"))
    budgets = make_budgets(spark, ("a", 1000, []))
    rules = {"MONTHLY": (50, 95, 96)}
    result = budget_alerts(ledger, budgets, rules, threshold_type="ABSOLUTE_VALUE")
    assert alerts(result) == [("a", 50), ("a", 95)]
    assert alerts(result, "DAILY") == []


def test_zero_limit_alerts_only_on_spend(spark):
    ledger = make_ledger(
        spark,
        ("spent", "2024-01-01T00:00:00", "0.01"),
        ("nothing", "2024-01-01T00:00:00", "0"),
        ("refunded", "2024-01-01T00:00:00", "-5"),
    )
    budgets = make_budgets(spark, *((app, 29, []) for app in ("spent", "nothing", "refunded")))
    assert alerts(budget_alerts(ledger, budgets), "DAILY") == [("spent", 80), ("spent", 100)]


def test_unknown_rules_are_rejected(spark):
    ledger = make_ledger(spark, ("a", "2024-01-01T00:00:00", "1"))
    budgets = make_budgets(spark, ("a", 1, []))
    with pytest.raises(ValueError, match="comparison"):
        budget_alerts(ledger, budgets, comparison="ABOUT")
    with pytest.raises(ValueError, match="threshold type"):
        budget_alerts(ledger, budgets, threshold_type="RELATIVE")
    with pytest.raises(ValueError, match="time unit"):
        budget_alerts(ledger, budgets, {"HOURLY": (1,)})
    with pytest.raises(ValueError, match="whole numbers"):
        budget_alerts(ledger, budgets, {"DAILY": (99.5,)})


def test_rules_may_be_empty(spark):
    ledger = make_ledger(spark, ("a", "2024-01-01T00:00:00", "100"))
    budgets = make_budgets(spark, ("a", 1, []))
    assert alerts(budget_alerts(ledger, budgets, {"DAILY": (), "MONTHLY": (100,)})) == [("a", 100)]
    assert budget_alerts(ledger, budgets, {"DAILY": ()}).count() == 0


def test_recipients(spark, rows):
    ledger = make_ledger(
        spark, *((app, "2024-01-01T00:00:00", "90.00") for app in ("two", "none", "null"))
    )
    budgets = make_budgets(
        spark, ("two", 100, ["x@a", "y@a"]), ("none", 100, []), ("null", 100, None)
    )
    result = alert_recipients(
        budget_alerts(ledger, budgets, {"MONTHLY": (90,)}), budgets
    )
    assert rows(result, "application", "threshold", "subscriber") == [
        ("two", 90, "x@a"),
        ("two", 90, "y@a"),
    ]


def test_hot_application_is_summed_before_the_shuffle(spark):
    """A third of all spend on one application and day reaches the shuffle as a row per task."""
    ledger = spark.range(0, 300_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), "id")).alias(
            "application"
        ),
        F.lit(dt.datetime(2024, 5, 17)).cast("timestamp_ntz").alias("ts"),
        F.lit(Decimal("1.00")).cast("decimal(18,2)").alias("amount"),
    )
    spend = spend_by_period(ledger)
    assert {r.spend for r in spend.filter("application = 'hot'").collect()} == {Decimal(100_000)}
    plan = spend._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("partial_sum(") > plan.rindex("Exchange hashpartitioning")


def test_day_sums_equal_the_ledger(spark, rows, tmp_path):
    """Rows that come in any order, late and negative, by application and day."""
    import random

    rng, path, held = random.Random(3), f"{tmp_path}/days", []
    schema = "application string, ts timestamp_ntz, amount decimal(18,2)"
    for turn in range(4):
        new = [
            (
                rng.choice(["a", "b", None]),
                dt.datetime(2023, 12, 25) + dt.timedelta(hours=rng.randrange(24 * 20)),
                Decimal(rng.randrange(-500, 1000)) / 4,
            )
            for _ in range(30)
        ]
        if turn == 2:
            new.append(("a", None, Decimal(7)))
        held += new
        add_to_days(spark.createDataFrame(new, schema), path)
        expected = spend_by_period(spark.createDataFrame(held, schema))
        assert rows(spend_from_days(spark, path)) == rows(expected)
    add_to_days(spark.createDataFrame([], schema), path)
    assert rows(spend_from_days(spark, path)) == rows(expected)


def test_only_touched_months_are_written(spark, tmp_path):
    path = tmp_path / "days"
    schema = "application string, ts timestamp_ntz, amount decimal(18,2)"

    def on(*months):
        rows_ = [("a", dt.datetime(2024, m, d), Decimal(1)) for m in months for d in (1, 9)]
        return spark.createDataFrame(rows_, schema)

    def files():
        return {p.parent.name: p.name for p in path.glob("month=*/*.parquet")}

    add_to_days(on(*range(1, 8)), str(path))
    before = files()
    add_to_days(on(3, 3, 12), str(path))
    after = files()
    assert len(before) == 7 and set(after) - set(before) == {"month=2024-12-01"}
    assert {month for month in before if before[month] != after[month]} == {"month=2024-03-01"}
    # A job that fails while it computes changes nothing.
    broken = on(4).withColumn("amount", F.raise_error(F.lit("broken")).cast("decimal(18,2)"))
    with pytest.raises(Exception, match="broken"):
        add_to_days(broken, str(path))
    assert files() == after
