"""Rounding and number text with Python's rules, as plain column arithmetic."""

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round1(x: Column) -> Column:
    """Round a double to one decimal as Python does: on the exact binary value, ties to even.

    ``F.round`` and ``F.bround`` work on the shortest decimal text of the double, so 33.35
    (stored a little above) and 0.85 * 41 style values land on the other side of the tie.
    The value is split so that ten times either half is exact; the sign of their sum
    against the half-way point is then exact too.
    """
    high = F.floor(x * 1048576.0) / F.lit(1048576.0)
    low = x - high
    whole = F.floor(high * 10.0 + low * 10.0)
    past_half = (high * 10.0 - whole - 0.5) + low * 10.0
    step = F.when(past_half > 0, F.lit(1)).when(past_half < 0, F.lit(0)).otherwise(
        F.pmod(whole, F.lit(2))
    )
    return (whole + step) / F.lit(10.0)


def is_whole(*numbers: Column) -> Column:
    """Whether all ``numbers`` are whole; a number that was given as 3.0 counts as 3."""
    return reduce(and_, [n.cast("double") % 1 == 0 for n in numbers])


def number_text(x: Column, whole: Column | None = None) -> Column:
    """A number as Python prints it: without a decimal if it is ``whole`` (unless given: if its value is)."""
    whole = is_whole(x) if whole is None else whole
    return F.coalesce(F.when(whole, x.try_cast("bigint").cast("string")), x.cast("double").cast("string"))


def whole_text(x: Column) -> Column:
    """``'%.0f'`` with ties to even."""
    return F.bround(x, 0).cast("bigint").cast("string")


def clamp_text(x: Column, low: int, high: int) -> Column:
    """Text of a clamped float: the bounds are integers and print without a decimal."""
    return (
        F.when(x >= high, F.lit(str(high))).when(x <= low, F.lit(str(low))).otherwise(x.cast("string"))
    )
