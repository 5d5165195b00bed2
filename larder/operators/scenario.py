"""Fortification scenarios: what intake would be if some foods were fortified."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import params
from larder.operators.intake import apparent_intake
from larder.operators.joins import na_join
from larder.sources.staging import stage
from larder.sources.tables import Survey


@dataclass(frozen=True)
class Vehicle:
    """Foods that carry added nutrients.

    ``items`` gives each item's fraction of the fortified ingredient: a mapping, an
    iterable of codes (fraction 1), or a frame (item_code, fraction). ``levels`` are per
    100 g, as is composition.
    """

    items: Mapping[int, float] | Iterable[int] | DataFrame
    levels: Mapping[str, float]
    losses: Mapping[str, float] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        if isinstance(self.items, DataFrame):
            return self.items.select("item_code", "fraction")
        items = dict(self.items) if isinstance(self.items, Mapping) else dict.fromkeys(self.items, 1.0)
        return params.literal_frame(spark, item_code=pa.array(list(items), pa.int32()),
                                    fraction=pa.array([float(v) for v in items.values()], pa.float64()))


MAIZE = Vehicle(params.MAIZE_ITEMS, params.MAIZE_LEVELS, params.FLOUR_LOSSES)
WHEAT = Vehicle(params.WHEAT_ITEMS, params.WHEAT_LEVELS, params.FLOUR_LOSSES)
OIL = Vehicle(params.OIL_ITEMS, params.OIL_LEVELS, params.OIL_LOSSES)
STANDARD_VEHICLES = (MAIZE, WHEAT, OIL)


def fortify(fct: DataFrame, vehicle: Vehicle) -> DataFrame:
    """Composition with the vehicle's nutrients *replaced* by level x fraction x (1 - loss).

    Works on the composition table, never on consumption.
    """
    joined = na_join(fct, vehicle.frame(fct.sparkSession).withColumnRenamed("fraction", "_fraction"), "item_code")
    carried = F.col("_fraction").isNotNull()
    return joined.withColumns({
        n: F.when(carried, F.lit(float(level)) * F.col("_fraction") * F.lit(1 - float(vehicle.losses.get(n, 0))))
        .otherwise(F.col(n))
        for n, level in vehicle.levels.items()
    }).drop("_fraction")


def fortify_all(fct: DataFrame, vehicles: Sequence[Vehicle]) -> DataFrame:
    """Vehicles in order; where two carry the same item, the later one holds."""
    for vehicle in vehicles:
        fct = fortify(fct, vehicle)
    return fct


def fortification_scenario(survey: Survey, nutrients: Sequence[str], vehicles: Sequence[Vehicle] = STANDARD_VEHICLES,
                           keep: Sequence[str] = ()) -> DataFrame:
    """Apparent intake under the scenario.

    The fortified composition is staged: its size is then known before consumption is
    read, so that a small one is broadcast and consumption joins it without a shuffle.
    """
    fortified = fortify_all(survey.fct, vehicles).select("item_code", *nutrients)
    return apparent_intake(survey.with_fct(stage(fortified)), nutrients, keep)
