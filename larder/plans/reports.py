"""The standard reports, each reading its household or child table as few times as it can.

``households`` is an intake table with the weight and the group columns carried along
(``apparent_intake(..., keep=[...])``, or the written intake joined to the household table).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import params
from larder.functions.missing import percent
from larder.functions.nutrition import below_requirement, iron_inadequacy, with_mar, with_mpa
from larder.operators import contribution, coverage, food_groups
from larder.operators.indicators import prevalence, short_name
from larder.operators.survey import SurveyDesign, gap, long, quintile_label
from larder.sources.staging import stage
from larder.sources.tables import Survey, write_report, write_table


def _indicators(households: DataFrame, weight: str, iron_weight: str | None, bioavailability: int,
                by: Sequence[str], digits: int) -> DataFrame:
    rows = with_mar(below_requirement(households, params.CUT_POINT_NUTRIENTS), params.CORE_NUTRIENTS)
    rows = rows.withColumn("_iron", iron_inadequacy(F.col("fe_mg"), bioavailability))
    design, iron = SurveyDesign(rows, weight), SurveyDesign(rows, iron_weight)
    return rows.groupBy(*by).agg(
        *[percent(design.mean_of(f"{n}_inadequate"), digits).alias(short_name(n)) for n in params.CUT_POINT_NUTRIENTS],
        percent(iron.mean_of("_iron"), digits).alias("fe_inadequacy"),
        percent(design.mean_of("mar_inadequate"), 1).alias("mar"))


def region_report(households: DataFrame, weight: str, by: Sequence[str] = ("adm1",),
                  iron_weight: str | None = None, bioavailability: int = 10) -> DataFrame:
    """Cut-point prevalence, iron prevalence and mean-adequacy-ratio inadequacy by group, one aggregate.

    Iron is weighted only if ``iron_weight`` names a column, as in the established
    regional figures. For a scenario, pass the households of ``fortification_scenario``.
    """
    return _indicators(households, weight, iron_weight, bioavailability, by, 0)


def national_report(households: DataFrame, weight: str, bioavailability: int = 10) -> DataFrame:
    """The same indicators for the whole population, all weighted, to one decimal."""
    return _indicators(households, weight, weight, bioavailability, [], 1)


def energy_report(food: DataFrame, hh: DataFrame, fct: DataFrame, mapping: DataFrame,
                  groups: DataFrame | None = None) -> DataFrame:
    """Energy shares: ``main`` (nutritious foods as one) and ``nutritious`` (each on its own)."""
    items = food_groups.item_energy(food_groups.item_quantity(food, hh), fct, groups)
    energy = food_groups.group_energy(food_groups.regroup(items, mapping))
    return (food_groups.energy_share(energy).withColumn("part", F.lit("main"))
            .unionByName(food_groups.energy_share(energy, breakdown=True).withColumn("part", F.lit("nutritious"))))


def mpi_report(households: DataFrame, weight: str) -> dict[str, DataFrame]:
    """Mean probability of inadequacy: national and regional with intervals, and by quintile.

    ``households`` needs ``adm1``, ``res`` and ``sep_quintile``; incomplete ones drop. The
    scored rows are staged, as three estimates read them.
    """
    rows = with_mpa(households).select("mpi", weight, "adm1", "res", "sep_quintile")
    design = SurveyDesign(stage(rows), weight).complete([weight, "mpi", "adm1", "sep_quintile"])
    return {
        "national": design.mean_ci("mpi", out="mean_mpi", digits=3),
        "region": design.mean_ci("mpi", ["adm1"], out="mean_mpi", digits=3).orderBy(F.col("mean_mpi").desc(), "adm1"),
        "gradient": design.mean_sets({"mpi": "mean_mpi"}, [["sep_quintile"], ["sep_quintile", "res"]], {"res": "Overall"}),
    }


def contribution_report(survey: Survey, intake: DataFrame, out: str,
                        nutrients: Sequence[str] = params.CORE_NUTRIENTS) -> dict[str, str]:
    """Write all shares, the five most telling items and the top-20 lists, a folder per nutrient each."""
    flags = below_requirement(intake, nutrients).select("hhid", *[f"{n}_inadequate" for n in nutrients])
    found = contribution.food_contributions_all(survey, flags, nutrients)
    shares = write_table(found, f"{out}/shares", "all", partition_by=["nutrient"])
    written = found.sparkSession.read.schema(found.schema).parquet(shares)
    delta = contribution.top_delta(contribution.contribution_table(written))
    top = contribution.top_n_others(written.filter(F.col("grp") == "total"))
    return {"shares": shares, "delta": write_report(delta, f"{out}/delta"), "top20": write_report(top, f"{out}/top20")}


def coverage_report(children: DataFrame, labels: DataFrame, regions: DataFrame,
                    drop: str = params.EXCLUDED_REGIONS) -> dict[str, DataFrame]:
    """Supplementation coverage: national, and every region against the target."""
    rows = coverage.child_vas(children)
    named = coverage.vas_region_named(coverage.vas_coverage(rows, by_region=True), labels, drop)
    return {"national": coverage.vas_coverage(rows), "region": coverage.target_class(named, regions)}


def stratified_report(households: DataFrame, weight: str,
                      nutrients: Sequence[str] = params.LONG_NUTRIENTS) -> dict[str, DataFrame]:
    """Long-format prevalence by residence, quintile and region, and the urban-rural gap in vitamin B12."""
    both = ["res", "res_quintile"]
    by_both = long(prevalence(households, weight, nutrients, both), both).filter(F.col("res_quintile").isNotNull())
    b12 = by_both.filter(F.col("micronutrient") == short_name("vitb12_mcg"))
    labelled = b12.withColumn("res_quintile", quintile_label(F.col("res_quintile")))
    return {
        "national": long(prevalence(households, weight, nutrients)),
        "residence": long(prevalence(households, weight, nutrients, ["res"]), ["res"]),
        "residence_quintile": by_both,
        "gap": gap(labelled, "res_quintile", "res", "Rural", "Urban"),
        "region": long(prevalence(households, weight, nutrients, ["adm1"]), ["adm1"]),
    }
