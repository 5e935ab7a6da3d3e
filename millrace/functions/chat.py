from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions._columns import as_column

# Defaults of a chat request.
DEFAULT_ROLE = "user"
DEFAULT_PARAMETERS = {"max_new_tokens": 400}


def message(role: Column | str, content: Column | str) -> Column:
    """One message as JSON."""
    fields = F.struct(as_column(role).alias("role"), as_column(content).alias("content"))
    return F.to_json(fields, {"ignoreNullFields": "false"})


def request_body(
    messages: Column | str,
    parameters: Mapping[str, object] = DEFAULT_PARAMETERS,
    stream: bool = False,
) -> Column:
    """The JSON body of a chat request from the JSON of its messages, joined by commas."""
    rest = json.dumps(
        {"parameters": dict(parameters), "stream": stream},
        ensure_ascii=False,
        separators=(",", ":"),
    )
    return F.concat(F.lit('{"messages":['), as_column(messages), F.lit("]," + rest[1:]))
