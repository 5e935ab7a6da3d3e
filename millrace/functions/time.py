from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType


def utc_day(df: DataFrame, column: str) -> Column:
    """The UTC calendar day of a timestamp, whatever the session's time zone.

    Timestamps without a zone are taken as UTC already.
    """
    if isinstance(df.schema[column].dataType, (DateType, TimestampNTZType)):
        return F.to_date(column)
    days = F.floor(F.unix_seconds(F.col(column)) / 86400)
    return F.date_from_unix_date(days.cast("int"))


def utc_instant(df: DataFrame, column: str) -> Column:
    """A timestamp with a zone; one without is taken as UTC."""
    if not isinstance(df.schema[column].dataType, TimestampNTZType):
        return F.col(column).cast("timestamp")
    since_epoch = F.col(column) - F.expr("timestamp_ntz'1970-01-01'")
    return F.expr("timestamp'1970-01-01 00:00:00Z'") + since_epoch
