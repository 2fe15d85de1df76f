"""Column functions, all evaluated in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    r"""Parts of ``text`` split at \r?\n; an empty text has one, a null gives null."""
    return F.when(text.isNotNull(), F.size(F.split(text, r"\r?\n", -1)).cast("bigint"))


def iso_millis(ts: Column) -> Column:
    """ISO-8601 in UTC with milliseconds; the session's time zone is to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
