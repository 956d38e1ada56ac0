"""Times as UTC wall clock (``timestamp_ntz``), so that no result depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three spellings a report's time may have, each with the mark that tells it from
# the other two. No text can match two of them.
SLASH_FORMAT = "dd/MM/yyyy HH:mm:ss"
BLANK_FORMAT = "yyyy-MM-dd HH:mm:ss"
LETTER_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def epoch_seconds(timestamp: Column) -> Column:
    """Whole seconds since 1970, of a ``timestamp_ntz``."""
    return F.unix_timestamp(timestamp)


def from_epoch(seconds: Column) -> Column:
    """``timestamp_ntz`` for whole seconds since 1970."""
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _parse(text: Column, pattern: str) -> Column:
    # The appended Z pins the text to UTC; without it the session zone would decide.
    return F.unix_timestamp(F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(pattern + "X")))


def parse_report_time(text: Column) -> Column:
    """Time of a report from its text, null when it has none of the three spellings.

    The mark picks the one pattern worth trying: a failed parse costs an exception per row.
    """
    trimmed = F.trim(text)
    return from_epoch(
        F.when(trimmed.contains("/"), _parse(trimmed, SLASH_FORMAT))
        .when(trimmed.contains("T"), _parse(trimmed, LETTER_FORMAT))
        .otherwise(_parse(trimmed, BLANK_FORMAT))
    )


def time_text(timestamp: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a ``timestamp_ntz`` (whole seconds)."""
    return from_epoch(epoch_seconds(timestamp)).cast("string")
