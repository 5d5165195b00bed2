"""Sources, sinks, labels and parameter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import params
from larder.catalogue import query, rounded
from larder.operators.intake import apparent_intake, base_model
from larder.plans.layout import read_bucketed, unique_name, write_bucketed
from larder.sources import schemas
from larder.sources.adapters import ISO3, SURVEY
from larder.sources.labelled import read_labelled, value_labels, write_labelled
from larder.sources.staging import stage_path
from larder.sources.tables import decode_with, labels_dim, read_survey, read_table, write_table

CORE = params.CORE_NUTRIENTS


@query("survey_load_counts", "hh fct cons", """
    SELECT 'hh_information' AS table_name, count(*) AS n_rows, count(afe) AS n_known FROM hh
    UNION ALL SELECT 'food_consumption', count(*), count(quantity_100g) FROM cons
    UNION ALL SELECT 'fct', count(*), count(energy_kcal) FROM fct""")
def survey_load_counts(t):
    """The three tables written under the survey's name and loaded by that name."""
    base, survey = stage_path(t.spark, "survey"), t.survey()
    for part, df, schema in (("hh_information", survey.hh, schemas.HH_INFORMATION),
                             ("food_consumption", survey.food, schemas.FOOD_CONSUMPTION),
                             ("fct", survey.fct, schemas.fct())):
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns]
                  ).write.parquet(f"{base}/{SURVEY}_{part}.parquet")
    loaded = read_survey(t.spark, SURVEY, base, fmt="parquet")
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.count(known).alias("n_known"))
              for name, df, known in (("hh_information", loaded.hh, "afe"),
                                      ("food_consumption", loaded.food, "quantity_100g"),
                                      ("fct", loaded.fct, "energy_kcal"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("write_read_roundtrip", "intake", f"""
    SELECT '{ISO3}' AS iso3, '{SURVEY}' AS survey, CAST(hhid AS VARCHAR) AS hhid,
           {", ".join(f"round({n}, 5) AS {n}" for n in params.NUTRIENTS)} FROM intake""")
def write_read_roundtrip(t):
    """The base intake table written as a CSV stage and read back with its schema."""
    base = base_model(apparent_intake(t.survey(), params.NUTRIENTS), ISO3, SURVEY)
    target = write_table(base, stage_path(t.spark, "base"), "intake", fmt="csv")
    return rounded(read_table(t.spark, target, schemas.intake()), 5)


@query("bucketed_intake", "intake", f"""
    SELECT CAST(hhid AS VARCHAR) AS hhid, {", ".join(f"round({n}, 5) AS {n}" for n in params.CORE_NUTRIENTS)} FROM intake""")
def bucketed_intake(t):
    """Intake from tables laid out by household."""
    name = unique_name("survey")
    write_bucketed(t.survey(), name, stage_path(t.spark, "bucketed"), 8)
    intake = apparent_intake(read_bucketed(t.spark, name, t.fct()), CORE)
    return rounded(intake.withColumn("hhid", F.col("hhid").cast("string")), 5)


@query("decode_labels", "persons region_labels", """
    SELECT l.label AS adm1, count(*) AS n_people FROM persons p LEFT JOIN region_labels l ON p.adm1 = l.code
    GROUP BY l.label""")
def decode_labels(t):
    labels = labels_dim(t.spark, params.REGION_LABELS)
    return decode_with(t.persons().select("adm1"), "adm1", labels).groupBy("adm1").agg(F.count("*").alias("n_people"))


SEXES, RESIDENCES = {1: "Male", 2: "Female"}, {1: "Rural", 2: "Urban"}


def _labelled_roster(t):
    """The roster as a folder of labelled files, unknown ages missing."""
    people = t.persons().withColumns({
        "age": F.when(F.col("age") >= 0, F.col("age")), "interviewed": F.make_date("year", "month", F.lit(1)),
        "weight": F.when(F.col("roster_id") % 13 != 0, F.col("survey_wgt"))})
    rows = people.select("hhid", "interview_id", "roster_id", "adm1", "sex", "res", "age", "interviewed", "weight")
    return write_labelled(rows, stage_path(t.spark, "roster"), {"adm1": params.REGION_LABELS, "sex": SEXES, "res": RESIDENCES})


@query("labelled_roster", "persons", """
    SELECT CAST(hhid AS INTEGER) AS hhid, CAST(interview_id AS VARCHAR) AS interview_id, CAST(roster_id AS INTEGER) AS roster_id, adm1, sex,
           CASE WHEN age >= 0 THEN age END AS age, make_date(CAST(year AS BIGINT), CAST(month AS BIGINT), 1) AS interviewed,
           CASE WHEN roster_id % 13 <> 0 THEN round(survey_wgt, 6) END AS weight FROM persons""")
def labelled_roster(t):
    """The roster written as labelled files and read again, all types and missing values."""
    return rounded(read_labelled(t.spark, _labelled_roster(t)).drop("res"))


@query("labelled_regions", "persons region_labels", """
    SELECT l.label AS adm1, CASE p.sex WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS sex, count(*) AS n_people
    FROM persons p LEFT JOIN region_labels l ON p.adm1 = l.code GROUP BY ALL""")
def labelled_regions(t):
    """Two columns of the labelled roster, decoded by the labels in the file."""
    path = _labelled_roster(t)
    meaning = value_labels(path)
    coded = read_labelled(t.spark, path, ["adm1", "sex"])
    counted = coded.groupBy("adm1", "sex").agg(F.count("*").alias("n_people"))
    for column in ("adm1", "sex"):
        counted = decode_with(counted, column, labels_dim(t.spark, meaning[column]))
    return counted


@query("ear_table", "intake", """
    SELECT e.nutrient, e.ear_value, count(u.intake) AS n_households,
           CAST(count(*) FILTER (WHERE u.intake < e.ear_value) AS BIGINT) AS n_below, round(avg(u.intake), 4) AS mean_intake
    FROM (UNPIVOT (SELECT {0} FROM intake) ON {0} INTO NAME nutrient VALUE intake) u
    JOIN (VALUES {1}) AS e(nutrient, ear_value) ON u.nutrient = e.nutrient GROUP BY e.nutrient, e.ear_value""".format(
        ", ".join(params.NUTRIENTS),
        ", ".join(f"('{n}', CAST({v} AS DOUBLE))" for n, v in params.REQUIREMENT.items())))
def ear_table(t):
    """Each requirement beside the intakes it is compared with.

    All nutrients are summed up in one wide aggregate; only its single row is turned long.
    """
    intake = apparent_intake(t.survey(), params.NUTRIENTS)
    wide = intake.agg(*[F.struct(
        F.lit(n).alias("nutrient"), F.count(n).alias("n_households"),
        F.count_if(F.col(n) < params.REQUIREMENT[n]).alias("n_below"), F.avg(n).alias("mean_intake")).alias(n)
        for n in params.NUTRIENTS])
    rows = wide.select(F.inline(F.array(*params.NUTRIENTS)))
    joined = params.requirement_frame(t.spark).join(F.broadcast(rows), "nutrient")
    return rounded(joined, 4, "mean_intake")
