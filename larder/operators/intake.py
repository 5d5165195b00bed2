"""Apparent nutrient intake per household."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.missing import ratio, total
from larder.operators.joins import SOLID_KEY, keyed, na_join, original_key, with_solid_key
from larder.sources.tables import Survey


def apparent_intake(survey: Survey, nutrients: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Daily intake per adult-female-equivalent of each household that reports food.

    One pass over consumption: composition joins on the item, nutrients are summed map-side
    before the only shuffle of the facts (on the household), and that partitioning
    also serves the join with the household table. ``keep`` carries household columns
    (weights, region) through this join, so that later steps need none. Tables bucketed by household
    (``plans/layout.py``) need no shuffle at all if composition is small enough to be sent out.
    """
    eaten = na_join(survey.food.select(*keyed(survey.food, "hhid"), "item_code", "quantity_100g"),
                    survey.fct.select("item_code", *nutrients), "item_code")
    sums = with_solid_key(eaten, "hhid").groupBy(*SOLID_KEY).agg(
        *[total(F.col(n) * F.col("quantity_100g")).alias(n) for n in nutrients])
    households = with_solid_key(survey.hh.select(*keyed(survey.hh, "hhid"), "afe", *keep), "hhid")
    return sums.join(households, SOLID_KEY, "left").select(
        original_key("hhid"), *[ratio(F.col(n), F.col("afe")).alias(n) for n in nutrients], *keep)


def base_model(intake: DataFrame, iso3: str, survey: str) -> DataFrame:
    """Intake tagged with country and survey, tags and household first."""
    rest = [c for c in intake.columns if c != "hhid"]
    return intake.select(F.lit(iso3).alias("iso3"), F.lit(survey).alias("survey"), "hhid", *rest)
