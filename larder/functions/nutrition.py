"""Household-level nutrition scores as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import params
from larder.functions.missing import indicator, row_mean
from larder.functions.stats import with_normal_cdf


def below_requirement(df: DataFrame, nutrients: Sequence[str],
                      requirement: Mapping[str, float] = params.REQUIREMENT) -> DataFrame:
    """Add ``<nutrient>_inadequate`` = 1 when intake is below the average requirement."""
    return df.withColumns({
        f"{n}_inadequate": indicator(F.col(n) < F.lit(float(requirement[n]))) for n in nutrients
    })


def iron_inadequacy(intake: Column, bioavailability: int = 10) -> Column:
    """Probability that an iron intake is inadequate, from the banded table.

    A bioavailability without a table gives NULL, as does a missing intake.
    """
    edges = params.IRON_EDGES.get(bioavailability)
    if edges is None:
        return F.lit(None).cast("double")
    *closed, open_band = params.IRON_PROBABILITY
    chain = F.when(intake <= edges[0], F.lit(closed[0]))
    for edge, probability in zip(edges[1:], closed[1:], strict=True):
        chain = chain.when(intake <= edge, F.lit(probability))
    return chain.when(intake > edges[-1], F.lit(open_band))


def adequacy_ratio(intake: Column, requirement: float) -> Column:
    """Intake / requirement, truncated at 1; missing stays missing."""
    share = intake / F.lit(float(requirement))
    return F.when(share > 1, F.lit(1.0)).otherwise(share)


def with_adequacy_ratios(df: DataFrame, nutrients: Sequence[str],
                         requirement: Mapping[str, float] = params.REQUIREMENT) -> DataFrame:
    return df.withColumns({f"{n}_nar": adequacy_ratio(F.col(n), requirement[n]) for n in nutrients})


def mean_adequacy_ratio(nutrients: Sequence[str],
                        requirement: Mapping[str, float] = params.REQUIREMENT) -> Column:
    return row_mean([adequacy_ratio(F.col(n), requirement[n]) for n in nutrients])


def with_mar(df: DataFrame, nutrients: Sequence[str], cut: float = 0.75,
             requirement: Mapping[str, float] = params.REQUIREMENT) -> DataFrame:
    """Add ``mar`` and its flag ``mar_inadequate`` (1 when below ``cut``)."""
    scored = df.withColumn("mar", mean_adequacy_ratio(nutrients, requirement))
    return scored.withColumn("mar_inadequate", indicator(F.col("mar") < cut))


def with_adequacy_probabilities(df: DataFrame, bioavailability: int = 10,
                                requirement: Mapping[str, float] = params.REQUIREMENT,
                                variation: Mapping[str, float] = params.VARIATION,
                                iron: str = "fe_mg") -> DataFrame:
    """Add ``pa_<nutrient>`` for every nutrient with a CV, and ``pa_<iron>`` from the bands.

    A requirement is normal with mean ``requirement`` and the given CV, so the probability
    that intake meets it is the normal distribution at the standardised intake.
    """
    scored = with_normal_cdf(df, {
        f"pa_{n}": (F.col(n) - F.lit(float(requirement[n]))) * F.lit(1 / (float(requirement[n]) * cv))
        for n, cv in variation.items()})
    # Adequacy of iron is defined for 10 % bioavailability only. The bands are tested on a
    # column that is never NULL, for the same reason as the distances in with_normal_cdf.
    inadequate = iron_inadequacy(F.col("_iron"), bioavailability if bioavailability == 10 else -1)
    return (scored.withColumn("_iron", F.coalesce(F.col(iron), F.lit(0.0)))
            .withColumn(f"pa_{iron}", F.when(F.col(iron).isNotNull(), F.lit(1.0) - inadequate)).drop("_iron"))


def with_mpa(df: DataFrame, cut: float = 0.5, bioavailability: int = 10,
             requirement: Mapping[str, float] = params.REQUIREMENT,
             variation: Mapping[str, float] = params.VARIATION, iron: str = "fe_mg") -> DataFrame:
    """Mean probability of adequacy, its flag, and the complement (inadequacy)."""
    scored = with_adequacy_probabilities(df, bioavailability, requirement, variation, iron)
    nutrients = [*variation, iron]
    # A probability is missing exactly when its intake is, iron away from 10 % excepted.
    present = [F.col(n) for n in variation] + [F.col(f"pa_{iron}")]
    mpa = row_mean([F.col(f"pa_{n}") for n in nutrients], present)
    return (scored.withColumn("mpa", mpa)
            .withColumns({"flag": indicator(F.col("mpa") < cut), "mpi": F.lit(1.0) - F.col("mpa")}))
