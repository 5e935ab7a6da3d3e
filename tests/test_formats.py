"""What is asked of Kafka and Iceberg, whose packages are not here to be run."""

from unittest.mock import MagicMock, call

import pytest

from millrace.plans import AppConfig, JobType, LakeTable, TopicInput
from millrace.sinks import write_table
from millrace.sources import kafka_options


def frame(exists):
    df = MagicMock()
    df.sparkSession.catalog.tableExists.return_value = exists
    return df


def test_iceberg_table_is_created_at_its_path():
    df = frame(exists=False)
    write_table(df, "goods_lake", "goods", path="s3a://bucket/products")
    df.writeTo.assert_called_once_with("`goods_lake`.`goods`")
    writer = df.writeTo.return_value.using.return_value
    df.writeTo.return_value.using.assert_called_once_with("iceberg")
    writer.tableProperty.assert_called_once_with("location", "s3a://bucket/products")
    assert writer.tableProperty.return_value.mock_calls == [call.create()]


def test_iceberg_table_is_appended_to():
    df = frame(exists=True)
    write_table(df, "goods_lake", "goods")
    assert df.writeTo.return_value.using.return_value.mock_calls == [call.append()]


def test_iceberg_rows_are_replaced_and_the_table_stays(spark):
    df = frame(exists=True)
    write_table(df, "goods_lake", "goods", mode="overwrite")
    (made,) = df.writeTo.return_value.using.return_value.mock_calls
    assert (made[0], str(made.args[0])) == ("overwrite", "Column<'true'>")
    with pytest.raises(ValueError, match="write mode"):
        write_table(df, "goods_lake", "goods", mode="ignore")


def test_lake_table_of_a_stream():
    df = MagicMock(isStreaming=True)
    config = AppConfig("orders", "orders-app", "0.0.1", "s3a://bucket/", "s3a://checkpoints")
    LakeTable("goods_lake", "sales").write(df, config)
    writer = df.writeStream.format.return_value
    df.writeStream.format.assert_called_once_with("iceberg")
    writer.option.assert_called_once_with(
        "checkpointLocation", "s3a://checkpoints/orders-app/goods_lake/sales"
    )
    placed = writer.option.return_value.option
    placed.assert_called_once_with("path", "s3a://bucket/goods_lake/sales")
    placed.return_value.trigger.assert_called_once_with(availableNow=True)
    placed.return_value.trigger.return_value.toTable.assert_called_once_with(
        "`goods_lake`.`sales`"
    )


@pytest.mark.parametrize(
    "job_type, reader", [(JobType.STREAMING, "readStream"), (JobType.ETL, "read")]
)
def test_kafka_topic(job_type, reader):
    spark = MagicMock()
    options = kafka_options("broker.example.com:9092", "sales_topic", "test", "test")
    TopicInput(options).read(spark, job_type)
    source = getattr(spark, reader).format
    source.assert_called_once_with("kafka")
    source.return_value.options.assert_called_once_with(**options)
    source.return_value.options.return_value.load.assert_called_once_with()
    assert options["subscribe"] == "sales_topic"
    assert options["kafka.sasl.mechanism"] == "PLAIN"
