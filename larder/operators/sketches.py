"""Approximate quantiles from stored sketches: a new diary round is merged, not scanned with the old ones.

A KLL sketch keeps some ``k`` values of a key whatever its number of rows (all of them up to
about ``k``: then nothing is approximate). Sketches are summed map-side, are plain binary columns that any table
stores, and merge in any order. With 99 % probability the rank of a quantile is off by at
most ``rank_error(k)`` of the key's rows; merging does not add to that.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.joins import na_join

K = 400


def rank_error(k: int = K) -> float:
    """Share of a key's rows by which the rank of a quantile can be off, at 99 % (the sketch's published bound)."""
    return 2.296 / k ** 0.9723


def sketched(df: DataFrame, key: str | Sequence[str] = "item_code", col: str = "quantity_g", k: int = K) -> DataFrame:
    """(key, n, sketch): known values of each key. A key without known values has no row."""
    keys = [key] if isinstance(key, str) else list(key)
    known = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    return known.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(col).cast("double"), k).alias("sketch"))


def merged(*sketches: DataFrame, k: int = K) -> DataFrame:
    """One sketch per key of all rounds; the rounds' rows are not read."""
    keys = [c for c in sketches[0].columns if c not in ("n", "sketch")]
    rounds = reduce(lambda a, b: a.unionByName(b), sketches)
    return rounds.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantile(probability: float, sketch: str = "sketch") -> Column:
    """The value that at least ``probability`` of the key's values do not exceed."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(probability)))


def quantiles(sketches: DataFrame, probabilities: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """The key, ``n`` and a column per probability."""
    names = list(names or [f"q{p:g}" for p in probabilities])
    return sketches.withColumns({n: quantile(p) for p, n in zip(probabilities, names, strict=True)}).drop("sketch")


def impute_from(df: DataFrame, sketches: DataFrame, key: str = "item_code", col: str = "quantity_g") -> DataFrame:
    """Fill missing values with the sketch's median of their key: one join, no ranking of values.

    ``impute_median`` is the exact way; here the median's rank can be off by ``rank_error``.
    """
    medians = sketches.select(key, quantile(0.5).alias("_median"))
    joined = na_join(df, medians, key)
    return joined.withColumn(col, F.coalesce(F.col(col), F.col("_median"))).drop("_median")
