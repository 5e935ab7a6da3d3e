from millrace.functions.chat import message, request_body
from millrace.functions.names import camel_form, is_valid_name
from millrace.functions.tags import default_tags, merge_tags, tag_filter
from millrace.functions.time import utc_day, utc_instant

__all__ = [
    "camel_form",
    "default_tags",
    "is_valid_name",
    "merge_tags",
    "message",
    "request_body",
    "tag_filter",
    "utc_day",
    "utc_instant",
]
