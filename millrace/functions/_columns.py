from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
