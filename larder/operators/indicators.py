"""Prevalence of inadequate intake from household intakes and weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import params
from larder.functions.missing import percent
from larder.functions.nutrition import below_requirement, iron_inadequacy, with_mar
from larder.operators.survey import SurveyDesign


def short_name(nutrient: str) -> str:
    """``vita_rae_mcg`` -> ``vita_inadequacy``."""
    return f"{nutrient.split('_')[0]}_inadequacy"


def prevalence(df: DataFrame, weight: str | None, nutrients: Sequence[str] = params.CUT_POINT_NUTRIENTS,
               by: Sequence[str] = (), digits: int | None = None, as_percent: bool = True,
               requirement: Mapping[str, float] = params.REQUIREMENT) -> DataFrame:
    """Weighted share of households below the requirement, per nutrient."""
    design = SurveyDesign(below_requirement(df, nutrients, requirement), weight)
    return design.mean({f"{n}_inadequate": short_name(n) for n in nutrients}, by, digits, as_percent)


def fe_prevalence(df: DataFrame, weight: str | None, by: Sequence[str] = (), bioavailability: int = 10,
                  digits: int | None = None, strict: bool = False, iron: str = "fe_mg",
                  out: str = "fe_inadequacy") -> DataFrame:
    """Iron prevalence (%) by full probability: the weighted mean of the banded probability.

    ``strict`` makes a group with any missing intake NULL; by default such rows are ignored.
    """
    design = SurveyDesign(df.withColumn("_p", iron_inadequacy(F.col(iron), bioavailability)), weight)
    estimate = percent(design.mean_of("_p"), digits)
    if strict:
        estimate = F.when(F.count_if(F.col("_p").isNull()) == 0, estimate)
    grouped = design.df.groupBy(*by) if by else design.df
    return grouped.agg(estimate.alias(out))


def mar_prevalence(df: DataFrame, weight: str | None, nutrients: Sequence[str] = params.CORE_NUTRIENTS,
                   by: Sequence[str] = (), cut: float = 0.75, digits: int = 1) -> DataFrame:
    """Weighted percent of households whose mean adequacy ratio is below ``cut``."""
    return SurveyDesign(with_mar(df, nutrients, cut), weight).mean(
        {"mar_inadequate": "mar"}, by, digits, as_percent=True)
