"""Exact money arithmetic on integer minor units.

Money columns are doubles holding values with at most two decimals (as the
feeds deliver them).  Arithmetic never runs on those doubles or on wide
decimals: values become whole cents (``LONG``), row-level products become
micro-units, and sums are long sums - exact, independent of aggregation
order, and inside whole-stage codegen.  (Spark multiplies ``DECIMAL`` values
through ``java.math.BigDecimal``, which is ~30x slower per row.)

Only per-group results are turned back into decimals (for half-up rounding
of averages) or doubles (for output): ``n / 100.0`` is the double nearest to
the exact decimal value, the same value any engine produces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUM_DEC = T.DecimalType(38, 2)
AVG_DEC = T.DecimalType(38, 6)


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def nearest_long(x: Column) -> Column:
    """Nearest integer of a double that is within rounding noise of one.

    ``floor(x + 0.5)`` is a single ``Math.floor``; Spark's ``round`` on a
    double goes through ``BigDecimal`` and costs microseconds per value.
    """
    return F.floor(x + F.lit(0.5)).cast("long")


def cents(c) -> Column:
    """Whole cents of a money value (exact for values with <= 2 decimals)."""
    return nearest_long(_c(c).cast("double") * 100)


def micros(c) -> Column:
    """Millionths of a money value given as a double with <= 6 decimals."""
    return nearest_long(_c(c).cast("double") * 1_000_000)


def from_cents(c) -> Column:
    return _c(c).cast("double") / F.lit(100.0)


def from_micros(c) -> Column:
    return _c(c).cast("double") / F.lit(1_000_000.0)


def div_half_up(num: Column, den: int) -> Column:
    """Integer division rounded half up, for non-negative numerators."""
    return F.floor((num + F.lit(den // 2)) / F.lit(den)).cast("long")


def sum_cents(c) -> Column:
    """Exact sum of a money column, in cents (long)."""
    return F.sum(cents(c))


def cents_to_decimal(c) -> Column:
    """Per-group conversion of a cents total to DECIMAL(38,2) (exact)."""
    return (_c(c).cast(T.DecimalType(38, 0)) * F.lit(0.01).cast(T.DecimalType(2, 2))).cast(SUM_DEC)


def money_sum(c) -> Column:
    """Exact money total as DECIMAL(38,2)."""
    return cents_to_decimal(sum_cents(c))


def avg2(total: Column, count: Column) -> Column:
    """Average of an exact decimal total, rounded half up to cents, as double."""
    return F.round((total / count).cast(AVG_DEC), 2).cast("double")
