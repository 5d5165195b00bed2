"""Contribution of single food items to nutrient intake, by risk group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder import params
from larder.functions.missing import total
from larder.operators.joins import SOLID_KEY, has_solid_key, keyed, na_join
from larder.sources.staging import stage
from larder.sources.tables import Survey

GROUPS = ("total", "risk", "not_risk")
OTHERS = "Others"
TOP_REPORTED = 20


def item_intakes(survey: Survey, flags: DataFrame | None, nutrients: Sequence[str],
                 groups: Sequence[str] = GROUPS) -> DataFrame:
    """Intake per item, one column ``<nutrient>__<group>`` per nutrient and risk group.

    ``flags`` holds ``hhid`` and ``<nutrient>_inadequate``; ``total`` also counts
    households whose flag is missing. Intake is composition times quantity, so
    quantities are summed first and composition joins one row per item: the facts are
    scanned once for every nutrient and group, and no hot item reaches a join.
    """
    households = survey.hh.select(*keyed(survey.hh, "hhid"), "afe")
    if set(groups) - {"total"}:
        if flags is None:
            raise ValueError("risk groups need household flags")
        # Joined household by household, so that the facts meet one table only, and staged:
        # flags usually come out of a join on the same key, whose partitioning Spark would
        # reuse, and a side that is not a plain shuffle cannot be split for a hot household.
        # The stage also has a known size, by which Spark may choose to broadcast it.
        households = stage(
            na_join(households, flags.select("hhid", *[f"{n}_inadequate" for n in nutrients]), "hhid"))
    food = survey.food.select(*keyed(survey.food, "hhid"), "item_code", "quantity_100g")
    if has_solid_key(food) and has_solid_key(households):  # both bucketed by household: they meet where they lie
        food = food.join(households.drop("hhid"), SOLID_KEY, "left")
    else:
        food = na_join(food, households.drop(*SOLID_KEY), "hhid")
    quantity = F.when(F.col("afe") > 0, F.try_divide(F.col("quantity_100g"), F.col("afe")))
    sums = []
    if "total" in groups:
        sums.append(F.sum(quantity).alias("_all"))
    wanted = {"risk": 1, "not_risk": 0}
    for n in nutrients:
        for g in [g for g in groups if g in wanted]:
            sums.append(F.sum(F.when(F.col(f"{n}_inadequate") == wanted[g], quantity)).alias(f"_{n}__{g}"))
    quantities = food.groupBy("item_code").agg(*sums)
    composed = na_join(quantities, survey.fct.select("item_code", "item_name", *nutrients), "item_code")
    return composed.groupBy("item_code", "item_name").agg(*[
        total(F.col(n) * F.col("_all" if g == "total" else f"_{n}__{g}")).alias(f"{n}__{g}")
        for n in nutrients for g in groups])


def food_contributions_all(survey: Survey, flags: DataFrame | None, nutrients: Sequence[str] = params.CORE_NUTRIENTS,
                           groups: Sequence[str] = GROUPS) -> DataFrame:
    """Percent of each nutrient's intake per item for every risk group: all items that contribute."""
    wide = item_intakes(survey, flags, nutrients, groups)
    columns = [f"{n}__{g}" for n in nutrients for g in groups]
    totals = wide.agg(*[F.sum(F.when(F.col(c) > 0, F.col(c))).alias(f"_total_{c}") for c in columns])
    shares = wide.crossJoin(F.broadcast(totals)).select(
        "item_code", "item_name",
        *[F.when(F.col(c) > 0, F.try_divide(F.col(c), F.col(f"_total_{c}")) * 100).alias(c) for c in columns])
    rows = shares.unpivot(["item_code", "item_name"], columns, "_pair", "contribution_pct").filter(
        F.col("contribution_pct").isNotNull())
    pair = F.split("_pair", "__")
    return rows.select(pair[0].alias("nutrient"), pair[1].alias("grp"), "item_code", "item_name", "contribution_pct")


def food_contribution(survey: Survey, flags: DataFrame | None, nutrient: str, group: str = "total") -> DataFrame:
    """Every item's share of one nutrient in one risk group."""
    if group not in GROUPS:
        raise ValueError(group)
    return food_contributions_all(survey, flags, [nutrient], [group]).select("item_code", "item_name", "contribution_pct")


def contribution_table(shares: DataFrame, by: Sequence[str] = ("nutrient",)) -> DataFrame:
    """Shares of the three groups side by side, 0 where an item contributes nothing, and
    ``contribution_pct_delta`` = not at risk minus at risk.

    ``shares`` comes from ``food_contributions_all``; an item with a share in any group gets
    a row, as three full joins would give, from one conditional aggregate.
    """
    keys = [*by, "item_code", "item_name"]
    names = {"total": "contribution_pct_all", "risk": "contribution_pct_risk", "not_risk": "contribution_pct_not_risk"}
    wide = shares.groupBy(*keys).agg(*[
        F.coalesce(F.max(F.when(F.col("grp") == g, F.col("contribution_pct"))), F.lit(0.0)).alias(c)
        for g, c in names.items()])
    return wide.withColumn("contribution_pct_delta",
                           F.col("contribution_pct_not_risk") - F.col("contribution_pct_risk"))


def top_delta(table: DataFrame, k: int = 5, by: Sequence[str] = ("nutrient",), digits: int = 1) -> DataFrame:
    """The ``k`` items whose share differs most in favour of households not at risk."""
    best = Window.partitionBy(*by).orderBy(F.col("contribution_pct_delta").desc(), "item_code", "item_name")
    shares = ["contribution_pct_not_risk", "contribution_pct_risk", "contribution_pct_delta"]
    return (table.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select(*by, "rank", "item_name", *[F.bround(c, digits).alias(c) for c in shares]))


def top_n_others(shares: DataFrame, n: int = TOP_REPORTED, by: Sequence[str] = ("nutrient",)) -> DataFrame:
    """The first ``n`` items by share and the sum of all other items.

    The rank filter is planned as a group limit, so each task passes on no more than ``n``
    rows per group, ties by item code and name; "Others" is what the listed items leave of the
    group's sum. That row is always there, 0 when nothing is left over. Whole percents.
    """
    best = Window.partitionBy(*by).orderBy(F.col("contribution_pct").desc(), "item_code", "item_name")
    listed = shares.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
    sums = shares.groupBy(*by).agg(total(F.col("contribution_pct")).alias("_all"))
    top = listed.groupBy(*by).agg(total(F.col("contribution_pct")).alias("_top"))
    # A row per group on either side.
    rest = na_join(sums, top, list(by)).select(
        *by, F.lit(n + 1).alias("rank"), F.lit(OTHERS).alias("item_name"),
        F.greatest(F.col("_all") - F.coalesce("_top", F.lit(0.0)), F.lit(0.0)).alias("contribution_pct"))
    rows = listed.select(*by, "rank", "item_name", "contribution_pct").unionByName(rest)
    rows = rows.withColumn("contribution_pct", F.bround("contribution_pct", 0))
    share = F.col("contribution_pct").cast("bigint").cast("string")
    return rows.withColumn("label", F.concat("item_name", F.lit("\n"), share, F.lit("%")))
