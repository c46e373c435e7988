"""Block time columns. Epoch seconds become TIMESTAMP_NTZ, so every
rendering is in UTC whatever the session time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats: the block-value job's time text (the double colon is part
# of it) and ISO-8601 UTC.
BLOCK_TIME_FORMAT = "yyyy-MM-dd HH::mm"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def epoch_to_ts(seconds: Column) -> Column:
    """Epoch seconds → TIMESTAMP_NTZ (UTC wall clock)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", seconds.cast("bigint"), epoch)


def block_time_text(seconds: Column) -> Column:
    return F.date_format(epoch_to_ts(seconds), BLOCK_TIME_FORMAT)


def iso_time_text(seconds: Column) -> Column:
    return F.date_format(epoch_to_ts(seconds), ISO_FORMAT)
