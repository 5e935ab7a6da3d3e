from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def kafka_options(
    bootstrap_servers: str,
    topic: str,
    username: str | None = None,
    password: str | None = None,
    protocol: str = "SASL_SSL",
) -> dict[str, str]:
    """Options of Spark's Kafka source for one topic, with plain credentials if given."""
    options = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topic}
    if username is not None:
        user, secret = (
            value.replace("\\", "\\\\").replace('"', '\\"') for value in (username, password or "")
        )
        options |= {
            "kafka.security.protocol": protocol,
            "kafka.sasl.mechanism": "PLAIN",
            "kafka.sasl.jaas.config": (
                "org.apache.kafka.common.security.plain.PlainLoginModule required "
                f'username="{user}" password="{secret}";'
            ),
        }
    return options


def read_topic(
    spark: SparkSession,
    options: Mapping[str, str],
    fmt: str = "kafka",
    schema: StructType | None = None,
    streaming: bool = True,
) -> DataFrame:
    """Read a topic with the columns its format gives; Kafka's key and value stay binary.

    ``fmt`` may be any streaming source: a file format needs ``schema`` and the option ``path``.
    With ``streaming=False`` what the topic holds now is read as a batch.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load()
