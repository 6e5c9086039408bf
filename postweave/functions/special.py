"""Special functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 8


def digamma(x: Column) -> Column:
    """The logarithmic derivative of the gamma function for x > 0, to some eleven digits.

    The recurrence digamma(x) = digamma(x + 1) - 1 / x moves the argument to where four terms of the asymptotic
    series are enough.
    """
    y = x + _SHIFT
    inverse = F.lit(1.0) / (y * y)
    series = F.log(y) - F.lit(0.5) / y - inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse / 240)))
    return series - sum((F.lit(1.0) / (x + step) for step in range(1, _SHIFT)), F.lit(1.0) / x)
