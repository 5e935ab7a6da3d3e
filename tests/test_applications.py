import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace.operators import alert_recipients, budget_alerts
from millrace.plans import (
    AppConfig,
    Application,
    JobType,
    LakeTable,
    TableInput,
    TopicInput,
    run_application,
)
from millrace.sinks import write_stream, write_table
from millrace.sources import kafka_options, read_table, read_topic

SCHEMA = "id bigint, name string"


@pytest.fixture
def lake(spark, tmp_path):
    name = f"lake_{tmp_path.name}".replace("-", "_")
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{tmp_path}/db'")
    return name


def config(tmp_path, app_id="products-app"):
    return AppConfig("products", app_id, "0.0.1", f"{tmp_path}/data", f"{tmp_path}/checkpoints")


def products(spark, lake, first=0, last=10):
    df = spark.range(first, last).withColumn("name", F.concat(F.lit("p"), "id"))
    write_table(df, lake, "source", "parquet")


def copy_app(lake, tmp_path, *tables, app_id="products-app"):
    return Application(
        config(tmp_path, app_id),
        {"products": TableInput(lake, "source")},
        [LakeTable(lake, table, fmt="parquet") for table in tables],
    )


def test_unknown_and_ambiguous_ids(spark, lake, tmp_path):
    app = copy_app(lake, tmp_path, "out")
    with pytest.raises(ValueError, match="No application has the id 'other'"):
        run_application(spark, [app], "other")
    with pytest.raises(ValueError, match="2 applications"):
        run_application(spark, [app, copy_app(lake, tmp_path, "out")], "products-app")
    with pytest.raises(ValueError):
        run_application(spark, [], "products-app")


def test_the_right_application_appends(spark, lake, tmp_path):
    products(spark, lake)
    apps = [copy_app(lake, tmp_path, name, app_id=name) for name in ("one", "two")]
    run_application(spark, apps, "two")
    run_application(spark, apps, "two")
    assert read_table(spark, lake, "two").count() == 20
    assert not spark.catalog.tableExists(f"{lake}.one")
    assert (tmp_path / "data" / lake / "two").is_dir()


def test_alerts_application(spark, lake, tmp_path, rows):
    """Two inputs joined in ``process``; each run replaces what the last one wrote."""

    class Alerts(Application):
        def process(self, inputs):
            alerts = budget_alerts(inputs["ledger"], inputs["budgets"], {"MONTHLY": (90, 100)})
            return alert_recipients(alerts, inputs["budgets"])

    ledger = spark.sql(
        "SELECT 'a' AS application, timestamp_ntz'2024-02-03 04:05:06' AS ts, "
        "cast(95 AS decimal(18,2)) AS amount"
    )
    budgets = spark.createDataFrame(
        [("a", 100, ["x@example.com"])],
        "application string, monthly_limit int, subscribers array<string>",
    )
    write_table(ledger, lake, "ledger", "parquet")
    write_table(budgets, lake, "budgets", "parquet")
    app = Alerts(
        config(tmp_path, "alerts-app"),
        {name: TableInput(lake, name) for name in ("ledger", "budgets")},
        [LakeTable(lake, "alerts", fmt="parquet", mode="overwrite")],
    )
    for _ in range(2):
        run_application(spark, [app], "alerts-app")
        written = rows(read_table(spark, lake, "alerts"), "application", "threshold", "subscriber")
        assert written == [("a", 90, "x@example.com")]


def test_two_tables_compute_once(spark, lake, tmp_path):
    products(spark, lake)
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    class Counted(Application):
        def process(self, inputs):
            return inputs["products"].mapInPandas(count, SCHEMA)

    app = copy_app(lake, tmp_path, "first", "second")
    run_application(spark, [Counted(app.config, app.inputs, app.writers)], "products-app")
    assert read_table(spark, lake, "first").count() == 10
    assert read_table(spark, lake, "second").count() == 10
    assert calls.value == 10


def test_streaming_job_adds_only_new_rows(spark, lake, tmp_path):
    products(spark, lake)
    app = copy_app(lake, tmp_path, "first", "second")
    run_application(spark, [app], "products-app", JobType.STREAMING)
    products(spark, lake, 10, 15)
    run_application(spark, [app], "products-app", JobType.STREAMING)
    for table in ("first", "second"):
        assert sorted(r.id for r in read_table(spark, lake, table).collect()) == [*range(15)]


def test_failing_stream_stops_the_others(spark, lake, tmp_path):
    products(spark, lake)

    class Broken(LakeTable):
        def write(self, df, config):
            return super().write(df.withColumn("bad", F.raise_error(F.lit("broken"))), config)

    endless = {"processingTime": "100 milliseconds"}
    app = Application(
        config(tmp_path),
        {"products": TableInput(lake, "source")},
        [
            LakeTable(lake, "good", fmt="parquet", trigger=endless),
            Broken(lake, "bad", fmt="parquet", trigger=endless),
        ],
    )
    with pytest.raises(Exception, match="broken"):
        run_application(spark, [app], "products-app", JobType.STREAMING)
    assert not spark.streams.active


def counted(calls):
    """An application that counts the rows it is given, on the executors."""

    def count(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    class Counted(Application):
        def process(self, inputs):
            return inputs["products"].mapInPandas(count, SCHEMA)

    return Counted


def test_a_stream_for_several_tables_is_read_once(spark, lake, tmp_path):
    products(spark, lake)
    calls = spark.sparkContext.accumulator(0)
    plain = copy_app(lake, tmp_path, "first", "second", "third")
    app = counted(calls)(plain.config, plain.inputs, plain.writers)
    run_application(spark, [app], "products-app", JobType.STREAMING)
    products(spark, lake, 10, 14)
    run_application(spark, [app], "products-app", JobType.STREAMING)
    run_application(spark, [app], "products-app", JobType.STREAMING)
    assert calls.value == 14
    for table in ("first", "second", "third"):
        assert sorted(r.id for r in read_table(spark, lake, table).collect()) == [*range(14)]


def test_a_crash_between_two_tables(spark, lake, tmp_path):
    """The second table fails midway; after a restart both have every row once."""
    products(spark, lake)

    class Broken(LakeTable):
        def write(self, df, config):
            fails = F.when(F.col("id") > 5, F.raise_error(F.lit("broken"))).otherwise(F.col("name"))
            return super().write(df.withColumn("name", fails), config)

    calls = spark.sparkContext.accumulator(0)
    plain = copy_app(lake, tmp_path, "first", "second")
    broken = counted(calls)(
        plain.config, plain.inputs, [plain.writers[0], Broken(lake, "second", fmt="parquet")]
    )
    with pytest.raises(Exception, match="broken"):
        run_application(spark, [broken], "products-app", JobType.STREAMING)
    products(spark, lake, 10, 12)
    whole = counted(calls)(plain.config, plain.inputs, plain.writers)
    run_application(spark, [whole], "products-app", JobType.STREAMING)
    for table in ("first", "second"):
        assert sorted(r.id for r in read_table(spark, lake, table).collect()) == [*range(12)]
    assert calls.value == 12


def test_topic_as_batch_and_as_stream(spark, lake, tmp_path):
    products(spark, lake)
    read_table(spark, lake, "source").write.parquet(f"{tmp_path}/topic")
    schema = spark.table(f"{lake}.source").schema
    source = TopicInput({"path": f"{tmp_path}/topic"}, "parquet", schema)
    for job_type in JobType:
        app = Application(
            config(tmp_path), {"orders": source}, [LakeTable(lake, job_type.value, fmt="parquet")]
        )
        run_application(spark, [app], "products-app", job_type)
        assert read_table(spark, lake, job_type.value).count() == 10


def test_missing_table(spark, lake):
    with pytest.raises(AnalysisException, match="TABLE_OR_VIEW_NOT_FOUND"):
        read_table(spark, lake, "nowhere")


def test_write_modes(spark, lake, tmp_path):
    products(spark, lake)
    one = spark.range(1).withColumn("name", F.lit("x"))
    write_table(one, lake, "source", "parquet", "overwrite")
    assert read_table(spark, lake, "source").count() == 1
    write_table(spark.range(3), lake, "placed", "parquet", path=f"{tmp_path}/elsewhere")
    write_table(spark.range(3), lake, "placed", "parquet", path=f"{tmp_path}/elsewhere")
    assert spark.read.parquet(f"{tmp_path}/elsewhere").count() == 6


def test_kafka_options():
    assert kafka_options("localhost:9092", "sales_topic") == {
        "kafka.bootstrap.servers": "localhost:9092",
        "subscribe": "sales_topic",
    }
    options = kafka_options("localhost:9092", "t", "us\"er", "pass\\word", "SASL_PLAINTEXT")
    assert options["kafka.security.protocol"] == "SASL_PLAINTEXT"
    assert options["kafka.sasl.jaas.config"].endswith(
        'username="us\\"er" password="pass\\\\word";'
    )


def test_stream_restart_adds_no_row_twice(spark, lake, tmp_path):
    products(spark, lake)
    schema = spark.table(f"{lake}.source").schema
    read_table(spark, lake, "source").repartition(4).write.parquet(f"{tmp_path}/topic")
    options = {"path": f"{tmp_path}/topic", "maxFilesPerTrigger": "1"}
    for _ in range(3):
        stream = read_topic(spark, options, "parquet", schema)
        write_stream(
            stream, f"{lake}.out", f"{tmp_path}/checkpoint", fmt="parquet"
        ).awaitTermination()
        assert read_table(spark, lake, "out").count() == 10


def test_a_stream_stopped_midway_goes_on(spark, lake, tmp_path):
    products(spark, lake)
    schema = spark.table(f"{lake}.source").schema
    read_table(spark, lake, "source").repartition(6).write.parquet(f"{tmp_path}/topic")
    options = {"path": f"{tmp_path}/topic", "maxFilesPerTrigger": "1"}

    def start(trigger):
        stream = read_topic(spark, options, "parquet", schema)
        return write_stream(stream, f"{lake}.out", f"{tmp_path}/checkpoint", trigger, "parquet")

    query = start({"processingTime": "100 milliseconds"})
    deadline = time.monotonic() + 60
    while not query.recentProgress and time.monotonic() < deadline:
        time.sleep(0.05)
    query.stop()
    assert 0 < read_table(spark, lake, "out").count()
    start({"availableNow": True}).awaitTermination()
    assert sorted(r.id for r in read_table(spark, lake, "out").collect()) == [*range(10)]


def test_a_failed_overwrite_keeps_the_old_rows(spark, lake, tmp_path, rows):
    old = spark.range(5).withColumn("name", F.lit("old"))
    fails = spark.range(3).withColumn(
        "name", F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.lit("x"))
    )
    for table, path in (("managed", None), ("external", f"{tmp_path}/placed")):
        write_table(old, lake, table, "parquet", path=path)
        with pytest.raises(Exception, match="broken"):
            write_table(fails, lake, table, "parquet", "overwrite")
        assert rows(read_table(spark, lake, table)) == [(k, "old") for k in range(5)]


@pytest.mark.parametrize("external", [False, True])
@pytest.mark.parametrize("partitioned", [False, True])
def test_a_table_is_overwritten_by_its_own_rows(spark, lake, tmp_path, rows, external, partitioned):
    path = f"{tmp_path}/placed" if external else None
    by = ["part"] if partitioned else []
    first = spark.range(10).withColumn("part", F.concat(F.lit("it's "), F.col("id") % 3))
    write_table(first, lake, "own", "parquet", "overwrite", path, by)
    spark.sql(f"ALTER TABLE {lake}.own SET TBLPROPERTIES ('owner team' = 'x''y')")
    expected = rows(first)
    for least in (2, 4, 7):
        own = read_table(spark, lake, "own").filter(F.col("id") >= least).select("id", "part")
        write_table(own, lake, "own", "parquet", "overwrite")
        expected = [r for r in expected if r[0] >= least]
        assert rows(read_table(spark, lake, "own"), "id", "part") == expected
    assert [c.name for c in spark.catalog.listColumns(f"{lake}.own") if c.isPartition] == by
    kept = spark.sql(f"SHOW TBLPROPERTIES {lake}.own ('owner team')").first().value
    assert kept == "x'y"
    write_table(first, lake, "own", "parquet")  # and it can still be appended to
    assert read_table(spark, lake, "own").count() == len(expected) + 10
    if external:
        versions = [p.name for p in (tmp_path / "placed").iterdir()]
        assert len(versions) == 1 and versions[0].startswith("_version-")
        files = read_table(spark, lake, "own").inputFiles()
        assert all(f"{tmp_path}/placed/" in f for f in files)


def test_an_overwrite_may_change_the_columns(spark, lake, rows):
    write_table(spark.range(3), lake, "changed", "parquet")
    other = spark.createDataFrame([("a", 1.5)], "name string, price double")
    write_table(other, lake, "changed", "parquet", "overwrite")
    assert rows(read_table(spark, lake, "changed")) == [("a", 1.5)]
    write_table(other.limit(0), lake, "changed", "parquet", "overwrite")
    assert rows(read_table(spark, lake, "changed")) == []
