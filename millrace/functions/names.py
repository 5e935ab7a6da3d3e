from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions._columns import as_column

# Fixed value: what an application name may look like. A closing newline is let through,
# and written out because `$` in Java would also accept other line ends.
NAME_PATTERN = r"^[a-z0-9-]+\n?\z"


def is_valid_name(name: Column | str) -> Column:
    """Whether a name has only lowercase letters, digits and hyphens."""
    return F.coalesce(as_column(name).rlike(NAME_PATTERN), F.lit(False))


def camel_form(name: Column | str) -> Column:
    """The words of a name, runs of ASCII letters and digits, capitalized and joined."""
    words = F.regexp_extract_all(as_column(name), F.lit("([a-zA-Z0-9]+)"), F.lit(1))
    return F.array_join(F.transform(words, F.initcap), "")
