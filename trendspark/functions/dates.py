"""Feed dates and epochs (O-X3, O-X22)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["parse_pub_date", "created_ts", "month_start_epoch", "DATETIME_FORMAT"]

# Accepted feed date layouts (RFC-822 with numeric offset or zone name,
# and the stored DATETIME form, two-digit years, ISO 8601); the weekday prefix is removed first.
FEED_DATE_PATTERNS = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd HH:mm:ss",
                      "d MMM yy HH:mm:ss Z", "d MMM yy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss"]
DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def parse_pub_date(raw: Column) -> Column:
    """RFC-822 feed date -> UTC TIMESTAMP; NULL when it does not parse."""
    s = F.trim(F.regexp_replace(raw, r"^\s*[A-Za-z]{3,9},\s*", ""))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in FEED_DATE_PATTERNS])


def created_ts(pub_date: Column, as_of_epoch: int) -> Column:
    """Article creation epoch: pub_date read as UTC, else the run time."""
    return F.coalesce(F.unix_timestamp(pub_date), F.lit(as_of_epoch)).cast("bigint")


def month_start_epoch(as_of: dt.datetime) -> int:
    """First day of the as-of month, 00:00 UTC, as epoch seconds."""
    m = as_of.replace(day=1, hour=0, minute=0, second=0, microsecond=0, tzinfo=dt.timezone.utc)
    return int(m.timestamp())
