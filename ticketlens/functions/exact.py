"""Rounded ratios and clock arithmetic that stay in 64-bit integers.

Rates are shown with a fixed number of decimals. Dividing doubles and rounding
afterwards moves ties between engines, so every ratio here is rounded half up in
integers and turned into a double once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def col(x: Column | str | int) -> Column:
    if isinstance(x, str):
        return F.col(x)
    if isinstance(x, int):
        return F.lit(x).cast("bigint")
    return x


def idiv(a: Column | str | int, b: Column | str | int) -> Column:
    """Integer division; NULL when the divisor is zero."""
    return F.call_function("div", col(a), F.nullif(col(b), F.lit(0).cast("bigint")))


def scaled(value: Column, digits: int) -> Column:
    return value.cast("double") / F.lit(float(10**digits))


def ratio_units(num: Column | str, den: Column | str | int, digits: int) -> Column:
    """``num / den`` in units of 10**-digits, rounded half away from zero (num >= 0)."""
    n, d = col(num).cast("bigint"), col(den).cast("bigint")
    return idiv(n * F.lit(2 * 10**digits).cast("bigint") + d, d * F.lit(2).cast("bigint"))


def ratio(num: Column | str, den: Column | str | int, digits: int) -> Column:
    return scaled(ratio_units(num, den, digits), digits)


def pct_units(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    return ratio_units(col(part) * F.lit(100).cast("bigint"), whole, digits)


def pct(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    return scaled(pct_units(part, whole, digits), digits)


def compliance_pct(breached: Column | str, known: Column | str) -> Column:
    """100 * (1 - breached / known), two decimals, NULL without known outcomes."""
    return pct(col(known) - col(breached), known, 2)


def big(x: Column | str) -> Column:
    """Wide integer for products that may pass 64 bits (used on aggregated rows only)."""
    return col(x).cast("decimal(38,0)")


def wide_ratio(num: Column, den: Column, digits: int) -> Column:
    """As :func:`ratio`, on decimal(38,0) operands."""
    units = F.call_function(
        "div", num * F.lit(2 * 10**digits) + den, F.nullif(den * F.lit(2), F.lit(0).cast("decimal(38,0)"))
    )
    return scaled(units, digits)


def units(value: Column | str, per: int) -> Column:
    """A value with few decimals in whole ``1 / per`` units, through doubles (fast path)."""
    return F.floor(col(value).cast("double") * F.lit(float(per)) + F.lit(0.5))


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


# --- clock -----------------------------------------------------------------------------
# All instants are timestamp_ntz holding UTC wall time, at second resolution, so no result
# depends on the session time zone.


def seconds(ts: Column | str) -> Column:
    return F.unix_timestamp(col(ts))


def from_seconds(secs: Column | str) -> Column:
    return F.timestamp_add("SECOND", col(secs), F.expr(EPOCH))


def plus_seconds(ts: Column | str, secs: Column | int) -> Column:
    return F.timestamp_add("SECOND", col(secs), col(ts))


def month_of(ts: Column | str) -> Column:
    return F.trunc(col(ts), "MM")


def week_of(ts: Column | str) -> Column:
    """Monday of the (UTC) week, as a date."""
    return F.trunc(col(ts), "WEEK")


def midnight(day: Column | str) -> Column:
    return col(day).cast("timestamp_ntz")


def hours_ticks(secs: Column) -> Column:
    """Seconds -> ten-thousandths of an hour, rounded (the resolution_hours contract)."""
    return idiv(secs * F.lit(50).cast("bigint") + F.lit(9).cast("bigint"), 18)
