"""Food diary -> clean daily grams per household and item."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import params
from larder.functions.missing import outside, ratio, total
from larder.operators.joins import na_join
from larder.operators.ordering import quantiles_exact
from larder.sources.staging import stage


def to_grams(df: DataFrame, qty: str = "quantity", unit: str = "unit",
             grams: Mapping[int, float] = params.UNIT_GRAMS) -> DataFrame:
    """Convert ``qty`` by unit code; units without an entry already are grams."""
    chain = None
    for code, factor in grams.items():
        scaled = F.col(qty) * F.lit(factor)
        chain = F.when(F.col(unit) == code, scaled) if chain is None else chain.when(F.col(unit) == code, scaled)
    return df if chain is None else df.withColumn(qty, chain.otherwise(F.col(qty)))


def exclude_items(df: DataFrame, codes: Sequence[int] = params.NON_FOOD_ITEMS, item: str = "item_code") -> DataFrame:
    """Drop listed items; rows without an item code stay."""
    return df.filter(outside(F.col(item), codes))


def daily_average(df: DataFrame, keys: Sequence[str] = ("interview_id", "item_code"), qty: str = "quantity",
                  days: int = params.DIARY_DAYS, out: str = "quantity_g") -> DataFrame:
    """Mean quantity per day over the reference period, per ``keys``."""
    return df.groupBy(*keys).agg((total(F.col(qty)) / days).alias(out))


def edible(df: DataFrame, portions: DataFrame, qty: str = "quantity_g") -> DataFrame:
    """Scale by the edible portion where one is known."""
    joined = na_join(df, portions.select("item_code", "edible_portion"), "item_code")
    known = F.col("edible_portion").isNotNull()
    return joined.withColumn(qty, F.when(known, F.col(qty) * F.col("edible_portion")).otherwise(F.col(qty)))


def crosswalk(roster: DataFrame, hh: DataFrame) -> DataFrame:
    """Households with the interview ids under which the diary knows them."""
    ids = roster.select("hhid", "interview_id").distinct()
    return na_join(hh.select("hhid", "afe"), ids, "hhid")


def per_afe(df: DataFrame, households: DataFrame, qty: str = "quantity_g") -> DataFrame:
    """Quantity per adult-female-equivalent; ``households`` is the crosswalk."""
    joined = na_join(df, households, "interview_id")
    return joined.withColumn(qty, ratio(F.col(qty), F.col("afe")))


def range_filter(df: DataFrame, qty: str = "quantity_g", hi: float = params.MAX_GRAMS_PER_AFE) -> DataFrame:
    """Keep non-zero quantities up to ``hi``; unknown quantities drop."""
    return df.filter((F.col(qty) != 0) & (F.col(qty) <= hi))


def log_cutpoint(df: DataFrame, key: str = "item_code", qty: str = "quantity_g", k: float = 3) -> DataFrame:
    """Per item: mean + k standard deviations of log10 quantity."""
    logs = F.log10(F.col(qty))
    return df.groupBy(key).agg((F.avg(logs) + F.lit(float(k)) * F.stddev_samp(logs)).alias("cutpoint"))


def null_outliers(df: DataFrame, cut: DataFrame, key: str = "item_code", qty: str = "quantity_g") -> DataFrame:
    """Blank quantities whose log10 lies above the item's cutpoint (none without a cutpoint)."""
    above = F.log10(F.col(qty)) > F.col("cutpoint")
    joined = na_join(df, cut.select(key, "cutpoint"), key)
    return joined.withColumn(qty, F.when(above, F.lit(None)).otherwise(F.col(qty))).drop("cutpoint")


def impute_median(df: DataFrame, key: str = "item_code", col: str = "quantity_g",
                  tie: Sequence[str] = ("hhid",)) -> DataFrame:
    """Fill missing values with the exact median of the key's known values.

    One aggregate says which keys have a gap and something to fill it with, and how many values
    that is; medians are taken only for those. Keys of few values are ranked in
    one shuffle; a key that holds much of the table is bracketed and never gathered (``quantiles_exact``).
    ``tie`` only spreads rows of one key and value, and need not be unique. ``df`` is read several times:
    stage it first.
    """
    counts = df.groupBy(key).agg(F.count(col).alias("_group_rows"), F.count_if(F.col(col).isNull()).alias("_gaps"))
    sizes = stage(counts.filter((F.col("_gaps") > 0) & (F.col("_group_rows") > 0)).select(key, "_group_rows"))
    medians = quantiles_exact(df.select(*dict.fromkeys([key, col, *tie])), col, [0.5], tie, by=[key], names=["_median"], sizes=sizes)
    joined = na_join(df, medians, key)
    return joined.withColumn(col, F.coalesce(F.col(col), F.col("_median"))).drop("_median")


def finalise_consumption(df: DataFrame, iso3: str, survey: str) -> DataFrame:
    """Back to household scale, plus quantity in 100 g and the survey tags."""
    household = F.col("quantity_g") * F.col("afe")
    return df.select(F.lit(iso3).alias("iso3"), F.lit(survey).alias("survey"), "hhid", "item_code",
                     household.alias("quantity_g"), (household / 100).alias("quantity_100g"))


def scaled_diary(diary: DataFrame, portions: DataFrame, households: DataFrame,
                 excluded: Sequence[int] = params.NON_FOOD_ITEMS) -> DataFrame:
    """The diary up to the range filter: one row per interview and item, per AFE."""
    daily = daily_average(exclude_items(to_grams(diary), excluded))
    return range_filter(per_afe(edible(daily, portions), households))


def clean_consumption(diary: DataFrame, portions: DataFrame, households: DataFrame, iso3: str, survey: str,
                      excluded: Sequence[int] = params.NON_FOOD_ITEMS, k: float = 3) -> DataFrame:
    """The whole cleaning job.

    The scaled diary is read by the cutpoints, the outlier test and the medians, and
    the blanked one by the medians and the fill: each is staged once instead of being
    recomputed from the raw diary.
    """
    scaled = stage(scaled_diary(diary, portions, households, excluded)
                   .select("interview_id", "hhid", "item_code", "quantity_g", "afe"))
    blanked = stage(null_outliers(scaled, log_cutpoint(scaled, k=k)))
    return finalise_consumption(impute_median(blanked), iso3, survey)
