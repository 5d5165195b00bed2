"""Region names: conforming, attaching estimates, label text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import params
from larder.operators.joins import na_join


def conform_regions(dim: DataFrame, drop: str = params.EXCLUDED_REGIONS,
                    recode: Mapping[str, str] = params.REGION_SPELLING, col: str = "adm1") -> DataFrame:
    """Drop regions whose name matches a pattern (or is missing) and unify spelling."""
    return dim.filter(~F.col(col).rlike(drop)).replace(dict(recode), subset=[col])


def join_regions(estimates: DataFrame, dim: DataFrame, keep: str = "estimates", col: str = "adm1") -> DataFrame:
    """Estimates with the region table; ``keep`` names the side whose rows all stay."""
    if keep == "estimates":
        return na_join(estimates, dim, col)
    if keep == "regions":
        return na_join(dim, estimates, col)
    raise ValueError(keep)


def label_rows(df: DataFrame, name: str, value: str, out: str = "label") -> DataFrame:
    """``name`` newline ``value`` percent sign, for rows that have both."""
    text = F.concat(F.col(name), F.lit("\n"), _plain(F.col(value)), F.lit("%"))
    return df.filter(F.col(name).isNotNull() & F.col(value).isNotNull()).withColumn(out, text)


def _plain(value):
    """A number as text, whole numbers without a decimal point."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
