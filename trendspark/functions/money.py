"""Token cost and report formatting (O-X14, O-X23)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["token_cost", "money_text", "traffic_text", "date_text", "yes_no", "COST_TYPE"]

COST_TYPE = "decimal(10,6)"


def token_cost(input_tokens: Column, output_tokens: Column, input_per_m: Column, output_per_m: Column) -> Column:
    """USD cost: in/1e6*p_in + out/1e6*p_out; missing usage or unknown model -> 0.

    Exact decimal arithmetic, multiplied by 1e-6 (never divided), stored as DECIMAL(10,6)."""
    # decimal(12,0) tokens keep the product within 38 digits, so it is exact (no early rounding)
    i = F.coalesce(input_tokens, F.lit(0)).cast("decimal(12,0)")
    o = F.coalesce(output_tokens, F.lit(0)).cast("decimal(12,0)")
    pi = F.coalesce(input_per_m, F.lit(0)).cast("decimal(10,4)")
    po = F.coalesce(output_per_m, F.lit(0)).cast("decimal(10,4)")
    return ((i * pi + o * po) * F.lit(0.000001).cast("decimal(7,6)")).cast(COST_TYPE)


def money_text(cost: Column, zero_is_na: bool = False) -> Column:
    """``$`` + 4 decimals; NULL (and, in the listing, 0) -> ``N/A``."""
    txt = F.concat(F.lit("$"), cost.cast("decimal(10,4)").cast("string"))
    na = cost.isNull() | (cost == 0) if zero_is_na else cost.isNull()
    return F.when(na, F.lit("N/A")).otherwise(txt)


def traffic_text(traffic: Column) -> Column:
    """``1,234K+``."""
    return F.concat(F.format_number(traffic, 0), F.lit("K+"))


def date_text(ts: Column, with_time: bool = True) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm" if with_time else "yyyy-MM-dd")


def yes_no(flag: Column) -> Column:
    return F.when(flag == 1, F.lit("Yes")).otherwise(F.lit("No"))
