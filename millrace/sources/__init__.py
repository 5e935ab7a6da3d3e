from millrace.sources.objects import (
    list_objects,
    objects_at,
    read_object_ranges,
    read_objects,
)
from millrace.sources.tables import read_table
from millrace.sources.topics import kafka_options, read_topic

__all__ = [
    "kafka_options",
    "list_objects",
    "objects_at",
    "read_object_ranges",
    "read_objects",
    "read_table",
    "read_topic",
]
