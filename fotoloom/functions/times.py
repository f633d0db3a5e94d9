"""Wall-clock times as microseconds, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(column: str) -> Column:
    """Microseconds of a `timestamp_ntz` since 1970-01-01 00:00 on the same wall clock."""
    c = f"`{column}`"
    return F.expr(
        f"(unix_date(cast({c} as date)) * 86400L + hour({c}) * 3600 + minute({c}) * 60) * 1000000L"
        f" + cast(extract(second from {c}) * 1000000 as bigint)"
    )


def from_micros(column: str) -> Column:
    return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(cast({column} as decimal(24, 0)) / 1000000 as decimal(18, 6)))")
