"""Tables bucketed by household: the same results without a shuffle of consumption."""

import re

import pytest
from pyspark.sql import functions as F

from larder.operators.contribution import item_intakes
from larder.operators.intake import apparent_intake
from larder.plans.layout import read_bucketed, unique_name, write_bucketed
from larder.sources.tables import Survey


@pytest.fixture
def surveys(spark, tmp_path):
    """A survey with missing households on both sides, plain and bucketed."""
    food = spark.range(3000).select(F.when(F.col("id") % 41 != 0, F.concat(F.lit("h"), (F.col("id") % 97).cast("string"))).alias("hhid"),
                                    (F.col("id") % 13).cast("int").alias("item_code"), (F.col("id") % 7 / 2).alias("quantity_100g"))
    hh = spark.range(90).select(F.when(F.col("id") > 0, F.concat(F.lit("h"), F.col("id").cast("string"))).alias("hhid"), (1.0 + F.col("id") % 4).alias("afe"))
    fct = spark.range(12).select(F.col("id").cast("int").alias("item_code"), F.concat(F.lit("item"), "id").alias("item_name"), (F.col("id") * 1.5).alias("zn_mg"))
    name = unique_name("t")
    write_bucketed(Survey(hh, food, fct), name, str(tmp_path), 4)
    yield Survey(hh, food, fct), read_bucketed(spark, name, fct)
    for part in ("food", "hh"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")


def rows_of(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_same_results(surveys):
    plain, laid_out = surveys
    assert rows_of(apparent_intake(plain, ["zn_mg"])) == rows_of(apparent_intake(laid_out, ["zn_mg"]))
    assert rows_of(item_intakes(plain, None, ["zn_mg"], ["total"])) == rows_of(item_intakes(laid_out, None, ["zn_mg"], ["total"]))
    flags = apparent_intake(plain, ["zn_mg"]).select("hhid", (F.col("zn_mg") < 50).cast("int").alias("zn_mg_inadequate"))
    assert rows_of(item_intakes(plain, flags, ["zn_mg"])) == rows_of(item_intakes(laid_out, flags, ["zn_mg"]))


def test_consumption_is_not_shuffled(spark, surveys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        intake = apparent_intake(surveys[1], ["zn_mg"])._jdf.queryExecution().executedPlan().toString()
        items = item_intakes(surveys[1], None, ["zn_mg"], ["total"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Bucketed: true" in intake and not re.search(r"Exchange hashpartitioning", intake)
    # Only what is summed up by item moves.
    assert all(x.startswith("item_code") for x in re.findall(r"Exchange hashpartitioning\((\w+)", items)) and "partial_sum" in items
