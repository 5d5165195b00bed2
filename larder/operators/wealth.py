"""Consumption aggregates -> wealth quintiles and the final household table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.joins import na_join
from larder.operators.ordering import first_per_key, ntile_exact

QUINTILES = 5
HOUSEHOLD_COLUMNS = ["survey", "hhid", "iso3", "zone", "adm1", "adm2", "ea", "res", "sep_quintile",
                     "res_quintile", "year", "month", "survey_wgt", "afe", "pc_expenditure"]


def consumption_per_hh(aggregates: DataFrame, roster: DataFrame) -> DataFrame:
    """Consumption and expenditure per household; the smallest row where ids repeat."""
    ids = roster.select("hhid", "interview_id").distinct()
    joined = na_join(aggregates.select("interview_id", "cons_aeq_adj", "exp_aeq_month"), ids, "interview_id")
    return first_per_key(joined.select("hhid", "cons_aeq_adj", "exp_aeq_month"), "hhid",
                         ["cons_aeq_adj", "exp_aeq_month"])


def quintile_overall(per_hh: DataFrame) -> DataFrame:
    return ntile_exact(per_hh, "cons_aeq_adj", QUINTILES, ["hhid"], "sep_quintile")


def quintile_by_residence(per_hh: DataFrame, residences: tuple[str, ...] = ("Rural", "Urban")) -> DataFrame:
    """Quintile within each residence, all in one ranking; other residences drop."""
    known = per_hh.filter(F.col("res").isin(*residences))
    return ntile_exact(known, "cons_aeq_adj", QUINTILES, ["hhid"], "res_quintile", by=["res"])


def with_quintiles(per_hh: DataFrame, hh: DataFrame) -> DataFrame:
    """Both quintiles and expenditure per household."""
    overall = quintile_overall(na_join(per_hh, hh.select("hhid", "res"), "hhid"))
    within = quintile_by_residence(overall.select("hhid", "res", "cons_aeq_adj"))
    return na_join(overall.select("hhid", "sep_quintile", F.col("exp_aeq_month").alias("pc_expenditure")),
                   within.select("hhid", "res_quintile"), "hhid")


def finalise_households(hh: DataFrame, quintiles: DataFrame, iso3: str, survey: str) -> DataFrame:
    """The 15-column household table; levels the survey lacks are typed NULLs."""
    unknown = F.lit(None).cast("string")
    joined = na_join(hh, quintiles, "hhid")
    return joined.withColumns({
        "survey": F.lit(survey), "iso3": F.lit(iso3), "zone": unknown, "adm2": unknown, "ea": unknown,
    }).select(*HOUSEHOLD_COLUMNS)
