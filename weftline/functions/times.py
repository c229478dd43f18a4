"""Times as whole numbers, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970; a timestamp without time zone counts as UTC, not as the session's local time."""
    if dict(df.dtypes)[column] == "timestamp":
        return F.unix_micros(column)
    local = F.col(column).cast("timestamp")
    return F.unix_micros(F.from_utc_timestamp(local, F.current_timezone()))
