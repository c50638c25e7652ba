"""Sums that stay in the type of their elements: wrap around, and are zero when empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUMMABLE = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def check_summable(kind: T.DataType) -> None:
    if not isinstance(kind, SUMMABLE):
        raise TypeError(f"summing needs int, long, float or double elements, not {kind.simpleString()}")


def wrapped(total: Column, kind: T.DataType) -> Column:
    """A whole number brought into the range of an int or a long by wrapping around."""
    if isinstance(kind, T.IntegerType):
        return F.shiftright(F.shiftleft(total, 32), 32).cast("int")
    half, whole = F.lit("9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)")
    return (F.pmod(total + half, whole) - half).cast("long")


def typed_sum(value: Column, kind: T.DataType) -> Column:
    """The sum of ``value`` in its own type.  Partial sums are combined as Spark likes.

    Ints are summed as longs, which is safe below 2**32 rows; longs as 38-digit
    decimals, which is safe below 10**19 rows.
    """
    check_summable(kind)
    if isinstance(kind, T.IntegerType):
        return wrapped(F.coalesce(F.sum(value.cast("long")), F.lit(0).cast("long")), kind)
    if isinstance(kind, T.LongType):
        return wrapped(F.coalesce(F.sum(value.cast("decimal(19,0)")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")), kind)
    return F.coalesce(F.sum(value), F.lit(0.0)).cast(kind)


def adder(kind: T.DataType):
    """``(zero, add)`` for an ordered fold in the elements' own type."""
    check_summable(kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.lit(0.0).cast(kind), lambda a, x: (a + F.coalesce(x, F.lit(0.0).cast(kind))).cast(kind)
    if isinstance(kind, T.IntegerType):
        return F.lit(0), lambda a, x: wrapped(a.cast("long") + F.coalesce(x, F.lit(0)).cast("long"), kind)
    wide = lambda x: x.cast("decimal(38,0)")
    return F.lit(0).cast("long"), lambda a, x: wrapped(wide(a) + wide(F.coalesce(x, F.lit(0).cast("long"))), kind)
