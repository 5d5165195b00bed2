"""From raw survey tables to the base intake table, every stage written once.

The order is set by what each stage reads: households (AFE) first, then wealth and the
diary, then intake. Each stage has its own path and the next one reads it from there,
so a failed job resumes from files and no table is overwritten while being read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from larder import params
from larder.operators import afe, cleaning, wealth
from larder.operators.intake import apparent_intake, base_model
from larder.sources.tables import Survey, write_table


@dataclass(frozen=True)
class RawSurvey:
    """Diary, edible portions, person roster, consumption aggregates, composition."""

    diary: DataFrame
    portions: DataFrame
    roster: DataFrame
    aggregates: DataFrame
    fct: DataFrame


@dataclass(frozen=True)
class BaseModel:
    """Paths of the written tables."""

    households: str
    consumption: str
    intake: str

    def survey(self, spark: SparkSession, fct: DataFrame) -> Survey:
        return Survey(spark.read.parquet(self.households), spark.read.parquet(self.consumption), fct)


def build(raw: RawSurvey, out: str, iso3: str, survey: str, nutrients: Sequence[str] = tuple(params.NUTRIENTS),
          regions: DataFrame | None = None, excluded: Sequence[int] = params.NON_FOOD_ITEMS) -> BaseModel:
    """Run the stages under ``out``; ``regions`` is a (code, label) frame if not the default."""
    spark = raw.roster.sparkSession
    people = afe.prepare_roster(raw.roster, raw.aggregates.select("interview_id", "date"), regions)
    with_afe = spark.read.parquet(write_table(afe.household_information(people), f"{out}/households", "afe"))

    per_hh = wealth.consumption_per_hh(raw.aggregates, raw.roster)
    households = wealth.finalise_households(with_afe, wealth.with_quintiles(per_hh, with_afe), iso3, survey)
    households_path = write_table(households, f"{out}/households", "wealth")

    crosswalk = cleaning.crosswalk(raw.roster, with_afe)
    food = cleaning.clean_consumption(raw.diary, raw.portions, crosswalk, iso3, survey, excluded)
    # Laid out by household: every later stage sums by household, and rows that already
    # lie together collapse before the shuffle. Ranges on both keys also cut up a household
    # that fills more than one partition.
    food_path = write_table(food.repartitionByRange("hhid", "item_code"), f"{out}/consumption", "clean")

    loaded = Survey(spark.read.parquet(households_path), spark.read.parquet(food_path), raw.fct)
    intake_path = write_table(base_model(apparent_intake(loaded, nutrients), iso3, survey), f"{out}/intake", "base")
    return BaseModel(households_path, food_path, intake_path)
