"""Column functions that write numbers for readers, and read them from what people wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(size: Column) -> Column:
    """Bytes in the largest unit up to PB that leaves at least one; null is "unknown"."""
    value = size.cast("double")
    out = F.format_string("%.1f PB", F.bround(value / 1024.0**5, 1))
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(F.abs(value) < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(value / 1024.0**power, 1))).otherwise(out)
    return F.when(size.isNull(), "unknown").otherwise(out)


def share(part: Column, whole: Column) -> Column:
    """part of whole; 0 of nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent(value: Column, digits: int = 1) -> Column:
    """A share as per cent with so many digits."""
    return F.format_string(f"%.{digits}f%%", F.bround(value * 100, digits))


def signed(value: Column) -> Column:
    """A whole difference with its sign and thousands apart."""
    return F.concat(F.when(value > 0, "+").otherwise(""), F.format_number(value, 0))


def signed_percent(value: Column) -> Column:
    """A difference of shares with its sign."""
    return F.concat(F.when(value > 0, "+").otherwise(""), percent(value))


def page_list(pages: Column) -> Column:
    """Pages with their counts: p.3 (2×), p.7 (1×)."""
    return F.array_join(F.transform(pages, lambda p: F.format_string("p.%d (%d×)", p["page_num"], p["count"])), ", ")


def number(value: Column, default: float = 0.0) -> Column:
    """A number from anything; the default where it is none."""
    return F.coalesce(F.when(~F.isnan(value.try_cast("double")), value.try_cast("double")), F.lit(float(default)))
