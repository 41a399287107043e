"""Comparisons of a column with bounds in the column's own type.

Fences are doubles; a whole number above 2^53 or a decimal is not, and a fence may lie outside the type. A bound is
therefore moved to the nearest value of the type inside it, exactly, and a side that no value of the type can be beyond
has no comparison at all.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import number, quoted

WHOLE_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _steps(data_type: T.DataType) -> tuple[int, int, int] | None:
    """``(least, greatest, scale)`` of an exact type: its values are whole numbers over 10^scale. None for floats."""
    for whole, bits in WHOLE_BITS.items():
        if isinstance(data_type, whole):
            return -(1 << (bits - 1)), (1 << (bits - 1)) - 1, 0
    if isinstance(data_type, T.DecimalType):
        return 1 - 10**data_type.precision, 10**data_type.precision - 1, data_type.scale
    return None


def _inside(bound: float, scale: int, up: bool) -> float | int:
    """The bound in steps of the type, moved inwards; infinities stay."""
    if math.isinf(bound):
        return bound
    exact = Fraction(bound) * 10**scale
    return math.ceil(exact) if up else math.floor(exact)


def _literal(steps: int, scale: int, data_type: T.DataType) -> Column:
    exact = Decimal((int(steps < 0), tuple(map(int, str(abs(steps)))), -scale)) if isinstance(data_type, T.DecimalType) else steps
    return F.lit(exact).cast(data_type)


def sides(column: str, low: float, high: float, data_type: T.DataType) -> tuple[Column, Column]:
    """Whether a value is below ``low`` and whether it is above ``high``; never so for NULL."""
    x, limits = quoted(column), _steps(data_type)
    if limits is None:
        return F.coalesce(number(column) < F.lit(float(low)), F.lit(False)), F.coalesce(number(column) > F.lit(float(high)), F.lit(False))
    least, greatest, scale = limits
    first, last = _inside(low, scale, True), _inside(high, scale, False)

    def beyond(bound, never: bool, always: bool, test) -> Column:
        if never:
            return F.lit(False)
        return x.isNotNull() if always else F.coalesce(test(_literal(bound, scale, data_type)), F.lit(False))

    below = beyond(first, first <= least, first > greatest, lambda bound: x < bound)
    above = beyond(last, last >= greatest, last < least, lambda bound: x > bound)
    return below, above


def clipped(column: str, low: float, high: float, data_type: T.DataType) -> Column:
    """The column with values beyond a bound replaced by the nearest value of its type inside; NULL stays."""
    x, limits = quoted(column), _steps(data_type)
    below, above = sides(column, low, high, data_type)
    if limits is None:
        return F.when(below, F.lit(float(low)).cast(data_type)).when(above, F.lit(float(high)).cast(data_type)).otherwise(x)
    least, greatest, scale = limits

    def bound(value: float | int) -> Column:
        return _literal(int(min(max(value, least), greatest)), scale, data_type)

    return F.when(below, bound(_inside(low, scale, True))).when(above, bound(_inside(high, scale, False))).otherwise(x)
