"""Consumption and households bucketed by household: jobs by household then shuffle neither.

Both tables are written with the household as a pair of columns that are never NULL (see
``with_solid_key``), since a missing household matches a missing one here, and bucketed and sorted by that pair.
A sum by household reads its buckets as they lie, and the household table joins on the
same buckets.

All rows of a household lie in one bucket, which one task reads. That is the point for households of ordinary
size; where one may hold a large part of all rows, leave the tables as ``base_model`` writes them: the plain plan sums
before it shuffles and can be split.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larder.operators.joins import SOLID_KEY, with_solid_key
from larder.sources.tables import Survey

PARTS = ("food", "hh")


def write_bucketed(survey: Survey, name: str, path: str, buckets: int) -> None:
    """Tables ``<name>_food`` and ``<name>_hh`` in the catalogue, their files under ``path``.

    Some 200 MB of consumption per bucket is a good number; it cannot be changed without writing again.
    """
    for part, df, order in (("food", survey.food, ["item_code"]), ("hh", survey.hh, [])):
        keyed = with_solid_key(df.withColumn("_household", df["hhid"]), "hhid").withColumnRenamed("_household", "hhid")
        # Dealt by the same key first: a file per bucket, not one per bucket and task.
        (keyed.repartition(buckets, *SOLID_KEY).write.bucketBy(buckets, *SOLID_KEY).sortBy(*SOLID_KEY, *order)
         .option("path", f"{path.rstrip('/')}/{part}").saveAsTable(f"{name}_{part}"))


def read_bucketed(spark: SparkSession, name: str, fct: DataFrame) -> Survey:
    return Survey(spark.table(f"{name}_hh"), spark.table(f"{name}_food"), fct)


def unique_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"
