"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(column: Column | str, places: int = 2) -> Column:
    """Scale, round to the nearest even integer, scale back (not Spark's HALF_UP ``round``)."""
    scale = float(10**places)
    column = F.col(column) if isinstance(column, str) else column
    return F.rint(column * scale) / scale


def round_half_up(column: Column | str, places: int) -> Column:
    """What ``F.round`` gives for a double, with its decimal arithmetic left to the values that need it.

    Scaling and the shortest decimal of a double are off by less than 2^-51 of the scaled value each. Farther than that from a
    tie its nearest integer is certain, and the quotient of two exact doubles is the double nearest to that decimal.
    """
    scale = F.lit(float(10**places))
    column = F.col(column) if isinstance(column, str) else column
    scaled = column * scale
    certain = F.abs(scaled - F.rint(scaled)) + F.abs(scaled) * F.lit(2.0**-50) < F.lit(0.5)
    # 0.0 is added because rint keeps the sign of a zero
    return F.when(certain, F.rint(scaled) / scale + F.lit(0.0)).otherwise(F.round(column, places))


def ratio_change(now: Column, before: Column) -> Column:
    """``now / before - 1``; NULL when either is missing or ``before`` is 0."""
    return F.try_divide(now, before) - F.lit(1.0)


def text_bucket(text: Column, buckets: Column) -> Column:
    """A bucket number from a digest of ``text``: even however the keys are numbered."""
    digest = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(digest, buckets)
