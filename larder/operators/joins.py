"""Joins in which a missing key matches a missing key.

Survey joins treat "missing" as a value, so keys compare null-safely. Spark plans
that as an equi-join on (coalesce(key), is-null(key)), never as a nested loop, so
it can broadcast a side or sort-merge, and adaptive execution can split a hot key.
No size hint is given here: whether a side is small enough to broadcast is left to
its actual size at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LEFT_ONLY = {"left_anti", "leftanti", "anti", "left_semi", "leftsemi", "semi"}
_BOTH_MAY_BE_ABSENT = {"full", "outer", "full_outer", "fullouter"}
_KEY, _MISSING = "_key", "_key_missing"


def na_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal column names; columns other than the keys must not clash."""
    keys = [on] if isinstance(on, str) else list(on)
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash and how not in _LEFT_ONLY:
        raise ValueError(f"columns on both sides: {sorted(clash)}; select before joining")
    right = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c)
                           for c in right.columns if c in keys or how not in _LEFT_ONLY])
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(right, condition, how)
    if how in _LEFT_ONLY:
        return joined
    if how in _BOTH_MAY_BE_ABSENT:
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"_right_{k}")) for k in keys})
    return joined.drop(*[f"_right_{k}" for k in keys])


def once_per_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row per key; a key with more rows raises when the plan runs, as it would multiply what is joined."""
    rest = [c for c in df.columns if c != key]
    twice = F.raise_error(F.concat(F.lit(f"more than one row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    one = df.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    return one.select(key, *[F.when(F.col("_n") > 1, twice.cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in rest])


def with_solid_key(df: DataFrame, key: str) -> DataFrame:
    """Replace ``key`` by a pair of columns that are never NULL.

    Grouping by the pair and then joining on it is null-safe *and* keeps one hash
    partitioning for both steps; a null-safe comparison of ``key`` itself would
    shuffle the aggregate a second time. A frame that has the pair already, as tables laid out
    by it do, keeps it, and with it the layout.
    """
    if has_solid_key(df):
        return df.drop(key)
    kind = df.schema[key].dataType
    if not isinstance(kind, (T.IntegralType, T.StringType, T.DoubleType)):
        raise TypeError(f"key {key} of type {kind.simpleString()}")
    return df.withColumns({
        _KEY: F.coalesce(F.col(key), F.lit("0").cast(kind)),
        _MISSING: F.col(key).isNull(),
    }).drop(key)


SOLID_KEY = [_KEY, _MISSING]


def has_solid_key(df: DataFrame) -> bool:
    return set(SOLID_KEY) <= set(df.columns)


def keyed(df: DataFrame, key: str) -> list[str]:
    """``key``, and its pair if the frame has that too."""
    return [key, *SOLID_KEY] if has_solid_key(df) else [key]


def original_key(key: str):
    """The column to select to get ``key`` back from its pair."""
    return F.when(~F.col(_MISSING), F.col(_KEY)).alias(key)
