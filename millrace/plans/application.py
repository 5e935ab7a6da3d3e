"""Applications: named inputs, a ``process`` that returns a DataFrame, and tables to write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.shared import Folder, materialize
from millrace.sinks.streams import AVAILABLE_NOW, write_stream
from millrace.sinks.tables import write_table
from millrace.sources.tables import read_table
from millrace.sources.topics import read_topic


class JobType(Enum):
    ETL = "etl"
    STREAMING = "streaming"


@dataclass(frozen=True)
class AppConfig:
    app_name: str
    app_id: str
    version: str
    database_bucket: str
    checkpoints_bucket: str


class Input(Protocol):
    def read(self, spark: SparkSession, job_type: JobType) -> DataFrame: ...


class Writer(Protocol):
    def write(self, df: DataFrame, config: AppConfig) -> StreamingQuery | None: ...


@dataclass(frozen=True)
class TableInput:
    """A catalog table, read whole by an ETL job and as it grows by a streaming job."""

    database: str
    table: str

    def read(self, spark: SparkSession, job_type: JobType) -> DataFrame:
        return read_table(
            spark, self.database, self.table, streaming=job_type is JobType.STREAMING
        )


@dataclass(frozen=True)
class TopicInput:
    """A topic, read up to now by an ETL job and continuously by a streaming job."""

    options: Mapping[str, str]
    fmt: str = "kafka"
    schema: StructType | None = None

    def read(self, spark: SparkSession, job_type: JobType) -> DataFrame:
        return read_topic(
            spark,
            self.options,
            self.fmt,
            self.schema,
            streaming=job_type is JobType.STREAMING,
        )


@dataclass(frozen=True)
class LakeTable:
    """A table to write. ``path`` defaults to a folder in the application's bucket.

    A batch is written with ``mode``. A stream is always appended, with a checkpoint of its own
    in the application's checkpoint bucket.
    """

    database: str
    table: str
    path: str | None = None
    fmt: str = "iceberg"
    mode: str = "append"
    partition_by: Sequence[str] = ()
    trigger: Mapping[str, object] = field(default_factory=lambda: AVAILABLE_NOW)

    def write(self, df: DataFrame, config: AppConfig) -> StreamingQuery | None:
        path = self.path or f"{config.database_bucket.rstrip('/')}/{self.database}/{self.table}"
        if not df.isStreaming:
            write_table(df, self.database, self.table, self.fmt, self.mode, path, self.partition_by)
            return None
        checkpoint = "/".join(
            [config.checkpoints_bucket.rstrip("/"), config.app_id, self.database, self.table]
        )
        name = f"`{self.database}`.`{self.table}`"
        return write_stream(
            df, name, checkpoint, self.trigger, self.fmt, path, self.partition_by
        )


class Application:
    """Subclass this and override :meth:`process`; as it is, it copies its only input."""

    def __init__(
        self, config: AppConfig, inputs: Mapping[str, Input], writers: Sequence[Writer]
    ) -> None:
        self.config = config
        self.inputs = dict(inputs)
        self.writers = list(writers)

    def process(self, inputs: Mapping[str, DataFrame]) -> DataFrame:
        (df,) = inputs.values()
        return df


def _staged(df: DataFrame, app: Application) -> tuple[DataFrame, list[StreamingQuery]]:
    """A stream of what ``df`` gives, from a folder to which a query of its own writes it.

    The folder is kept beside the application's checkpoints. Its query and those of the tables
    each know how far they have come, so one that broke off goes on where it was: every row is
    computed once, and each table gets it once.
    """
    folder = f"{app.config.checkpoints_bucket.rstrip('/')}/{app.config.app_id}/_staged"
    triggers = [dict(writer.trigger) for writer in app.writers if isinstance(writer, LakeTable)]
    trigger = triggers[0] if triggers else AVAILABLE_NOW
    query = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/rows")
        .trigger(**trigger)
        .start()
    )
    running = [query]
    if "availableNow" in trigger or "once" in trigger:
        query.awaitTermination()  # the tables take what is there then
        running = []
    Folder(df.sparkSession, f"{folder}/rows").make()
    return df.sparkSession.readStream.schema(df.schema).parquet(f"{folder}/rows"), running


def run_application(
    spark: SparkSession,
    apps: Sequence[Application],
    app_id: str,
    job_type: JobType = JobType.ETL,
) -> None:
    """Run the application with the given id and write its result to all its tables.

    A result for several tables is computed once. A batch is kept in the shared folder while they
    are written. A stream is staged in a folder beside the application's checkpoints, and each
    table is filled from there by its own query, also after a restart: whatever was running when
    a job broke off, no table misses a row or has one twice. The call returns when all queries
    have ended, and if one fails it stops the others and raises.
    """
    matches = [app for app in apps if app.config.app_id == app_id]
    if not matches:
        raise ValueError(f"No application has the id {app_id!r}")
    if len(matches) > 1:
        raise ValueError(f"{len(matches)} applications have the id {app_id!r}")
    (app,) = matches

    df = app.process({name: source.read(spark, job_type) for name, source in app.inputs.items()})
    running: list[StreamingQuery] = []
    try:
        if len(app.writers) > 1:
            if df.isStreaming:
                df, running = _staged(df, app)
            else:
                df = materialize(df)
        for writer in app.writers:
            query = writer.write(df, app.config)
            if query is not None:
                running.append(query)
        while running:
            running = [query for query in running if not query.awaitTermination(1)]
    finally:
        for query in running:
            query.stop()
