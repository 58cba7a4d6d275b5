"""Column helpers that pin the numeric, date and null rules of the results.

The results are specified by SQL whose rounding, decimal and date-difference
rules differ from Spark's defaults, so every operator goes through these
helpers instead of calling ``round`` or ``timestampdiff`` directly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

# An undecorated NUMERIC in the specification is DECIMAL(18,3).
NUMERIC = T.DecimalType(18, 3)


def round_double(value: Column, digits: int) -> Column:
    """Round a double half away from zero on its binary value.

    ``F.round`` rounds the shortest decimal text instead (1.005 -> 1.01).
    """
    scale = float(10**digits)
    rounded = F.signum(value) * F.floor(F.abs(value) * scale + F.lit(0.5)) / F.lit(scale)
    # Beyond 2^53 units a double has no fraction left; infinities and NaN stay too.
    return F.when(F.abs(value) * scale < F.lit(2.0**53), rounded).otherwise(value)


def round_half_even(value: Column, digits: int) -> Column:
    """Round a double as Python's ``round`` does: by its exact binary value, ties to even.

    The product with the power of ten is itself rounded, so where it seems to be a tie the
    sign of its error decides; the error is exact, from factors split in halves.
    """
    scale = F.lit(float(10**digits))
    product = value * scale
    wide = value * F.lit(2.0**27 + 1)
    high = wide - (wide - value)
    error = (high * scale - product) + (value - high) * scale
    whole = F.floor(product).cast("double")
    tie = product - whole == 0.5
    rounded = F.when(tie & (error > 0), whole + 1).when(tie & (error < 0), whole).otherwise(F.rint(product))
    return F.when(F.abs(product) < F.lit(2.0**52), rounded / scale).otherwise(value)


def numeric(value: Column, digits: int) -> Column:
    """Cast to NUMERIC and then round: two roundings, at 3 and at ``digits``."""
    cast = value.cast(NUMERIC)
    return cast if digits >= NUMERIC.scale else F.round(cast, digits).cast(T.DecimalType(18, digits))


def money(value: Column) -> Column:
    """NUMERIC amount with two decimals."""
    return numeric(value, 2)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division in double precision; NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    """``part`` as a percentage (0-100) of ``total``."""
    return round_double(ratio(part.cast("double") * F.lit(100.0), total), digits)


def mean(total: Column, count: Column) -> Column:
    """Mean from an exact sum and a count."""
    return ratio(total, count)


def hour_boundaries(start: Column, end: Column) -> Column:
    """Number of full-hour boundaries crossed: 00:59 -> 01:01 is 1."""
    days = F.datediff(end, start).cast("long")
    return days * F.lit(24) + F.hour(end).cast("long") - F.hour(start).cast("long")


def day_boundaries(start: Column, end: Column) -> Column:
    """Number of midnights crossed: 23:59 -> 00:01 is 1."""
    return F.datediff(end, start).cast("long")


def _time_of_day(value: Column) -> Column:
    seconds = F.hour(value) * 3600 + F.minute(value) * 60
    return seconds + F.date_part(F.lit("SECOND"), value)


def whole_days(start: Column, end: Column) -> Column:
    """Complete 24-hour periods between two times, rounded down."""
    incomplete = (_time_of_day(end) < _time_of_day(start)).cast("long")
    return F.datediff(end, start).cast("long") - incomplete


def month_of(value: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(value, "month")


def week_of(value: Column) -> Column:
    """Monday of the week, as a date."""
    return F.trunc(value, "week")


def weekday(value: Column) -> Column:
    """Day of week with Sunday as 0."""
    return F.dayofweek(value) - 1


def month_index(value: Column) -> Column:
    """Months since year 0, so that differences are calendar-month distances."""
    return F.year(value).cast("long") * 12 + F.month(value).cast("long")


def bucket_label(value: Column, buckets: Sequence[tuple[int | None, int | None, str]], other: str) -> Column:
    """Label of the first closed interval holding ``value``, else ``other``.

    An open end of an interval is None.  NULL values get ``other``, as in a
    searched CASE with an ELSE branch.
    """
    label: Column | None = None
    for low, high, text in buckets:
        if low is None:
            inside = value <= F.lit(high)
        elif high is None:
            inside = value >= F.lit(low)
        else:
            inside = value.between(low, high)
        label = F.when(inside, F.lit(text)) if label is None else label.when(inside, F.lit(text))
    return F.lit(other) if label is None else label.otherwise(F.lit(other))


def is_finite(value: Column) -> Column:
    """True for a double that is neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
