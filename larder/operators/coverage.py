"""Vitamin A supplementation coverage of children aged 6-59 months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import params
from larder.functions.missing import indicator
from larder.operators.joins import na_join
from larder.operators.survey import SurveyDesign


def child_base(df: DataFrame) -> DataFrame:
    """Weight, region code and age in months (from the birth date where not recorded)."""
    return df.withColumns({
        "wt": F.col("v005") / 1000000,
        "adm1": F.col("v024"),
        "age": F.coalesce(F.col("b19"), F.col("v008") - F.col("b3")),
    })


def eligible(df: DataFrame) -> DataFrame:
    """1 for living children aged 6-59 months, NULL where that is unknown."""
    return df.withColumn("eligible_child", indicator(
        (F.col("age") >= 6) & (F.col("age") <= 59) & (F.col("b5") == 1)))


def dose_date(df: DataFrame) -> DataFrame:
    """Date of the last dose; unknown day -> the 15th, unknown month or year -> NULL."""
    day = F.when(F.col("h33d").isNull() | (F.col("h33d") == params.UNKNOWN_MONTH_OR_DAY),
                 F.lit(params.ASSUMED_DAY)).otherwise(F.col("h33d"))
    month = F.nullif(F.col("h33m"), F.lit(params.UNKNOWN_MONTH_OR_DAY))
    year = F.nullif(F.col("h33y"), F.lit(params.UNKNOWN_YEAR))
    text = F.concat(year.cast("string"), F.lit("-"), month.cast("string"), F.lit("-"), day.cast("string"))
    return df.withColumn("dose_date", F.try_to_date(text, "yyyy-M-d"))


def months_since(df: DataFrame) -> DataFrame:
    """Months from dose to interview, in the interview's day count; negative if later."""
    days = F.datediff("dose_date", F.lit(params.DAY_COUNT_ORIGIN).cast("date")) + params.DAY_COUNT_OFFSET
    return df.withColumn("months_since_vita", (F.col("v008a") - days) / F.lit(params.DAYS_PER_MONTH))


def vas_indicator(df: DataFrame) -> DataFrame:
    """1 if recalled or dosed within 6 months, else 0; NULL for children not eligible."""
    return df.withColumn("vas_child", (
        F.when(F.col("eligible_child") == 0, F.lit(None).cast("int"))
        .when(F.col("h34") == 1, F.lit(1))
        .when(F.col("months_since_vita") <= 6, F.lit(1))
        .otherwise(F.lit(0))))


def child_vas(df: DataFrame) -> DataFrame:
    """All child-level columns from the raw table, in one projection."""
    return vas_indicator(months_since(dose_date(eligible(child_base(df)))))


def late_doses(children: DataFrame) -> DataFrame:
    """How many doses are dated after the interview (they count as recent)."""
    return children.agg(F.count_if(F.col("months_since_vita") < 0).alias("late_doses"))


def vas_coverage(children: DataFrame, by_region: bool = False) -> DataFrame:
    """Weighted percent covered among eligible children."""
    design = SurveyDesign(children.filter(F.col("eligible_child") == 1), "wt")
    return design.mean({"vas_child": "vas_coverage"}, ["adm1"] if by_region else [], as_percent=True)


def vas_region_named(coverage: DataFrame, labels: DataFrame, drop: str = params.EXCLUDED_REGIONS) -> DataFrame:
    """Named regions in title case with coverage in whole percent, highest first.

    ``labels`` is (code, label). Regions without a label cannot pass the name test.
    """
    named = na_join(coverage, labels.select(F.col("code").cast("int").alias("adm1"), "label"), "adm1")
    return (named.select(F.initcap("label").alias("adm1"), F.bround("vas_coverage", 0).alias("vas_coverage"))
            .filter(~F.col("adm1").rlike(drop)).orderBy(F.col("vas_coverage").desc(), "adm1"))


def target_class(coverage: DataFrame, regions: DataFrame, target: float = params.COVERAGE_TARGET) -> DataFrame:
    """Every region with its (rounded) coverage and whether that reaches the target."""
    joined = na_join(regions, coverage, "adm1")
    return joined.withColumn("target_class", (
        F.when(F.col("vas_coverage") >= target, F.lit(f"{target:g}% or above"))
        .when(F.col("vas_coverage") < target, F.lit(f"Below {target:g}%"))))
