from millrace.sinks.objects import delete_objects, put_objects
from millrace.sinks.streams import read_updates, write_stream, write_updates
from millrace.sinks.tables import write_table

__all__ = [
    "delete_objects",
    "put_objects",
    "read_updates",
    "write_stream",
    "write_table",
    "write_updates",
]
