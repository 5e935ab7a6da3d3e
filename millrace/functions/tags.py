from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions._columns import as_column


def default_tags(application: Column | str, tool: str = "millrace") -> Column:
    """The tags every resource of an application carries."""
    return F.create_map(
        F.lit("application"), as_column(application), F.lit("tool"), F.lit(tool)
    )


def merge_tags(default: Column | str, user: Column | str) -> Column:
    """Both maps in one; where they share a key the user's value counts, even if null.

    The shared keys leave the defaults first, because ``map_concat`` rejects duplicates.
    """
    none = F.create_map().cast("map<string,string>")
    default = F.coalesce(as_column(default), none)
    user = F.coalesce(as_column(user), none)
    kept = F.map_filter(default, lambda key, _: ~F.map_contains_key(user, key))
    return F.map_concat(kept, user)


def tag_filter(df: DataFrame, key: str, value: str, tags: str = "tags") -> DataFrame:
    """The rows tagged ``key`` = ``value``.

    For many applications at once, project ``tags['application']`` and group or join on it
    instead of filtering once per application.
    """
    return df.filter(F.col(tags)[key] == value)
