"""Energy shares of food groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder import params
from larder.functions.missing import ratio, total
from larder.operators.joins import na_join, once_per_key

NUTRITIOUS = "Nutritious foods"


def item_quantity(food: DataFrame, hh: DataFrame) -> DataFrame:
    """Total quantity per AFE (100 g) of each item.

    Summed before composition is joined: the facts are reduced to one row per item, so
    no later join sees a hot item.
    """
    joined = na_join(food.select("hhid", "item_code", "quantity_100g"), hh.select("hhid", "afe"), "hhid", "inner")
    return joined.groupBy("item_code").agg(total(ratio(F.col("quantity_100g"), F.col("afe"))).alias("qty100g"))


def item_energy(quantities: DataFrame, fct: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Energy of each item's quantity with its food group.

    ``groups`` is an (item_code, food_group) table; without it ``fct`` has the group.
    """
    columns = ["item_code", "energy_kcal"] + (["food_group"] if groups is None else [])
    joined = na_join(quantities, fct.select(*columns), "item_code")
    if groups is not None:
        joined = na_join(joined, groups.select("item_code", "food_group"), "item_code")
    return joined.withColumn("energy_kcal", F.col("energy_kcal") * F.col("qty100g"))


def regroup(df: DataFrame, mapping: DataFrame, default: str = params.OTHER_FOODS) -> DataFrame:
    """Food group -> reported group; unknown or missing groups take ``default``.

    A group with two entries in ``mapping`` is refused when the plan runs.
    """
    joined = na_join(df, once_per_key(mapping.select("food_group", "food_group_new"), "food_group"), "food_group")
    return joined.withColumn("food_group_new", F.coalesce(F.col("food_group_new"), F.lit(default)))


def group_energy(items: DataFrame, group: str = "food_group_new") -> DataFrame:
    return items.groupBy(group).agg(total(F.col("energy_kcal")).alias("totalenergy_kcal"))


def energy_share(energy: DataFrame, nutritious: Sequence[str] = params.NUTRITIOUS_GROUPS, breakdown: bool = False,
                 group: str = "food_group_new") -> DataFrame:
    """Percent of all energy per group, ranked, with a label.

    By default the nutritious groups are merged into one and empty groups drop;
    ``breakdown`` keeps only the nutritious groups, each on its own. Either way the
    base is the energy of all groups. The windows span the reported groups: a handful.
    """
    everything = Window.partitionBy(F.lit(0))
    energy = energy.withColumn("_overall", F.sum("totalenergy_kcal").over(everything))
    inside = F.col(group).isin(*nutritious)
    if breakdown:
        parts = energy.filter(inside)
    else:
        merged = F.when(inside, F.lit(NUTRITIOUS)).otherwise(F.col(group)).alias(group)
        parts = (energy.select(merged, "totalenergy_kcal", "_overall").groupBy(group)
                 .agg(total(F.col("totalenergy_kcal")).alias("totalenergy_kcal"), F.first("_overall").alias("_overall"))
                 .filter(F.col("totalenergy_kcal") > 0))
    shares = parts.withColumn(
        "energypct", ratio(100 * F.col("totalenergy_kcal"), F.col("_overall"))).drop("_overall")
    order = everything.orderBy(F.col("energypct").desc(), F.col(group))
    return shares.withColumns({
        "rank": F.row_number().over(order),
        "label": F.concat(F.bround("energypct", 0).cast("bigint").cast("string"), F.lit("%")),
    })
