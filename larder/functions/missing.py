"""Missing-value rules shared by every operator.

Survey tables are full of missing cells, and the estimates depend on how each
one is treated. Spark's NULL plays the part of "missing"; NaN never enters
(see ``drop_nan``), because Spark orders NaN above every number.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def indicator(condition: Column) -> Column:
    """1/0 for true/false, NULL when the condition itself is unknown."""
    return condition.cast("int")


def blank_if(condition: Column, value: Column) -> Column:
    """``value``, blanked when the condition is true *or unknown*."""
    return F.when(~condition, value)


def total(value: Column) -> Column:
    """Sum that skips missing values; a group with none left sums to 0."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def outside(value: Column, codes: Iterable) -> Column:
    """True unless ``value`` is one of ``codes``; a missing value is kept."""
    codes = list(codes)
    return value.isNull() | ~value.isin(codes) if codes else F.lit(True)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL, not an error or infinity, on a zero divisor."""
    return F.try_divide(numerator, denominator)


def drop_nan(value: Column) -> Column:
    """NaN read from a file becomes NULL."""
    return F.nanvl(value, F.lit(None).cast("double"))


def row_mean(values: Sequence[Column], present: Sequence[Column] | None = None) -> Column:
    """Mean across columns of one row over the values present; NULL if none is.

    ``present`` may name cheaper columns that are missing exactly when the values are,
    so that a long expression is not spelled out twice.
    """
    known = [v.isNotNull().cast("int") for v in (values if present is None else present)]
    filled = [F.coalesce(v, F.lit(0.0)) for v in values]
    return ratio(_plus(filled), _plus(known))


def percent(share: Column, digits: int | None = None) -> Column:
    """Share -> percent, rounded half-to-even when ``digits`` is given."""
    scaled = share * 100
    return scaled if digits is None else F.bround(scaled, digits)


def _plus(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for column in columns[1:]:
        out = out + column
    return out
