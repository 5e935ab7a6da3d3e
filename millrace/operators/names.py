from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import camel_form, is_valid_name


def name_audit(df: DataFrame, column: str) -> DataFrame:
    """For each distinct name: is it valid, its camel form, and how many names share that form.

    The forms are counted with a combined aggregation and joined back, because one form may
    be shared by very many names; a window over it would put them all in one task.
    """
    names = (
        df.select(F.col(column).alias("name"))
        .filter("name is not null")
        .distinct()
        .select(
            "name",
            is_valid_name("name").alias("ok"),
            F.coalesce(camel_form("name"), F.lit("")).alias("camel"),
        )
    )
    shared = (
        names.groupBy("camel").agg(F.count("*").alias("same_camel")).filter("same_camel > 1")
    )
    return names.join(shared, "camel", "left").select(
        "name", "ok", "camel", F.coalesce("same_camel", F.lit(1)).alias("same_camel")
    )
