"""Traffic strings -> thousands (O-X1, O-X2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendspark.functions.text import php_trim

__all__ = ["parse_traffic", "migrate_traffic", "leading_number"]


def leading_number(s: Column) -> Column:
    """Numeric prefix as a float, like PHP ``floatval`` on ``[0-9.]+`` text; '' -> 0."""
    prefix = F.regexp_extract(s, r"^[0-9]*(\.[0-9]*)?", 0)
    return F.coalesce(prefix.try_cast("double"), F.lit(0.0))


def parse_traffic(c: Column) -> Column:
    """``^([0-9.]+)([KMB])?.*$`` (case-insensitive) on the trimmed text.

    M -> x1000, B -> x1,000,000, K or none -> x1, truncated; no match -> 0.
    ``200+`` -> 200, ``1,000+`` -> 1, ``2 M`` -> 2, ``1.2.3K`` -> 1.
    """
    t = php_trim(c)
    digits = F.regexp_extract(t, r"^([0-9.]+)", 1)
    unit = F.upper(F.regexp_extract(t, r"^[0-9.]+([KMBkmb])", 1))
    mult = F.when(unit == "M", F.lit(1000.0)).when(unit == "B", F.lit(1000000.0)).otherwise(F.lit(1.0))
    value = F.floor(leading_number(digits) * mult).cast("bigint")
    # '.' does not cross a newline in the reference pattern, so an inner newline is no match
    matched = (digits != "") & ~F.instr(t, "\n").cast("boolean")
    return F.when(c.isNull(), F.lit(0).cast("bigint")).when(matched, value).otherwise(F.lit(0).cast("bigint"))


def migrate_traffic(c: Column) -> Column:
    """Bulk legacy conversion (O-X2): digits and dots kept; a case-insensitive ``M``
    anywhere -> x1000 (tested before ``B`` -> x1,000,000) on a DECIMAL(10,2) value,
    else the integer prefix. Blank stays unset -> 0 once the column is NOT NULL."""
    kept = F.regexp_replace(c, r"[^0-9.]", "")
    dec = F.regexp_extract(kept, r"^[0-9]*(\.[0-9]*)?", 0)
    dec = F.when(dec.isin("", "."), F.lit("0")).otherwise(dec).try_cast("decimal(10,2)")
    whole = F.regexp_extract(kept, r"^[0-9]*", 0)
    whole = F.when(whole == "", F.lit("0")).otherwise(whole).try_cast("bigint")
    up = F.upper(c)
    out = (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit(0).cast("bigint"))
        .when(up.contains("M"), F.round(dec * F.lit(1000)).cast("bigint"))
        .when(up.contains("B"), F.round(dec * F.lit(1000000)).cast("bigint"))
        .otherwise(whole)
    )
    return out
