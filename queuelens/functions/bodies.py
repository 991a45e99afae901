"""Body text of generated messages, both directions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entry id, body template and time format of generated messages.
ENTRY_ID = "msg-%d"
BODY = "%s-%d | batch=%d | ts=%s | total=%d"
BODY_PATTERN = r"^.*-(\d+) \| batch=(\d+) \| ts=([^|]*) \| total=(\d+)$"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def message_body(n: Column, batch: Column, ts: Column, total: Column, prefix: str) -> Column:
    return F.format_string(BODY, F.lit(prefix), n, batch, ts, total)


def body_field(body: Column, group: int) -> Column:
    """One field of a generated body, NULL when the text has another form."""
    return F.nullif(F.regexp_extract(body, BODY_PATTERN, group), F.lit(""))
