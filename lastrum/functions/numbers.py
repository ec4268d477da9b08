"""Rounding that doesn't depend on the order in which a sum was taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals at which the noise of floating sums is cut off.
NOISE_DIGITS = 9


def fixed(x: Column | str, digits: int = 0) -> Column:
    """x rounded half up to digits decimals, from its value to nine decimals: reruns agree, also where a value lies midway."""
    return F.round(F.round(x, NOISE_DIGITS), digits)
