"""Person roster -> adult-female-equivalents (AFE) per household."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import params
from larder.functions.missing import blank_if, total
from larder.operators.joins import na_join
from larder.operators.ordering import first_per_key
from larder.sources.tables import decode, decode_with, labels_dim

PERSON_KEY = ["hhid", "interview_id", "roster_id"]
HH_ATTRIBUTES = ["adm1", "res", "survey_wgt", "year", "month"]


def decode_roster(df: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Labels for residence, sex and region codes."""
    regions = regions if regions is not None else labels_dim(df.sparkSession, params.REGION_LABELS)
    df = decode(decode(df, "res", params.RESIDENCE_LABELS), "sex", params.SEX_LABELS)
    return decode_with(df, "adm1", regions)


def split_yyyymm(df: DataFrame, col: str = "date") -> DataFrame:
    """``year`` and ``month`` from the first six characters; NULL where not a number."""
    return df.withColumns({
        "year": F.substring(col, 1, 4).try_cast("int"),
        "month": F.substring(col, 5, 2).try_cast("int"),
    })


def attach_date(roster: DataFrame, dates: DataFrame) -> DataFrame:
    return na_join(roster, split_yyyymm(dates).select("interview_id", "year", "month"), "interview_id")


def clean_birth(df: DataFrame) -> DataFrame:
    """Blank births after the interview and months that do not exist.

    A comparison with a missing date is unknown, and then the value is blanked too.
    """
    year = blank_if(F.col("year_birth") > F.col("year"), F.col("year_birth"))
    df = df.withColumn("year_birth", year)
    later = (F.col("year_birth") == F.col("year")) & (F.col("month_birth") > F.col("month"))
    df = df.withColumn("month_birth", blank_if(later, F.col("month_birth")))
    return df.withColumn("month_birth", blank_if(F.col("month_birth") > 12, F.col("month_birth")))


def recode_sentinel(df: DataFrame, col: str = "age", sentinel: int = -9998, value: int = 0) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) == sentinel, F.lit(value)).otherwise(F.col(col)))


def age_months() -> Column:
    return ((F.col("year") - F.col("year_birth")) * 12 + (F.col("month") - F.col("month_birth")))


def is_under2() -> Column:
    return (F.col("age") <= 2) & (age_months() <= 24)


def under2(df: DataFrame) -> DataFrame:
    return df.filter(is_under2()).select(*PERSON_KEY, "sex", age_months().alias("age_months"))


def children(df: DataFrame, u2: DataFrame) -> DataFrame:
    """Ages 2-17 without the under-2 group, by person key."""
    aged = df.filter((F.col("age") >= 2) & (F.col("age") < 18)).select(*PERSON_KEY, "sex", "age")
    return na_join(aged, u2.select(*PERSON_KEY), PERSON_KEY, "left_anti")


def adults(df: DataFrame) -> DataFrame:
    return df.filter(F.col("age") >= 18).select(*PERSON_KEY, "sex", "age")


def kcal_under2(months: Column) -> Column:
    chain = None
    for first, last, kcal in params.INFANT_KCAL:
        inside = months <= last if first is None else months >= first
        if first is not None and last is not None:
            inside = inside & (months <= last)
        chain = F.when(inside, F.lit(kcal)) if chain is None else chain.when(inside, F.lit(kcal))
    return chain


def kcal_child(sex: Column, age: Column, fix_f15: bool = False) -> Column:
    """Energy need by sex and single year of age.

    Girls aged exactly 15 have no value unless ``fix_f15``. Fractional ages match no
    year, but girls strictly between 15 and 18 share one value.
    """
    whole = age == F.floor(age)
    slot = F.floor(age).cast("int") - 2
    boys = F.get(F.array(*[F.lit(float(v)) for v in params.BOY_KCAL]), slot)
    girls = F.get(F.array(*[F.lit(float(v)) for v in params.GIRL_KCAL]), slot)
    older = (age >= 15 if fix_f15 else age > 15) & (age < 18)
    return (F.when((sex == "Male") & whole, boys)
            .when((sex == "Female") & older, F.lit(params.OLDER_GIRL_KCAL))
            .when((sex == "Female") & whole, girls))


def kcal_adult(sex: Column, age: Column) -> Column:
    """Basal metabolic rate by sex and age band, times the activity level."""
    chain = None
    for label, kg, bands in (("Male", params.MALE_KG, params.MALE_BMR), ("Female", params.FEMALE_KG, params.FEMALE_BMR)):
        for (start, slope, intercept), nxt in zip(bands, [*bands[1:], None], strict=True):
            inside = (sex == label) & (age >= start)
            if nxt is not None:
                inside = inside & (age < nxt[0])
            bmr = F.lit(slope * kg + intercept)
            chain = F.when(inside, bmr) if chain is None else chain.when(inside, bmr)
    return chain * F.lit(params.ACTIVITY_LEVEL)


def person_afe(kcal: Column) -> Column:
    return kcal / F.lit(params.KCAL_PER_AFE)


def with_person_afe(df: DataFrame, fix_f15: bool = False) -> DataFrame:
    """Add ``grp`` and ``afe`` in one pass over the roster.

    The three age groups are disjoint row by row, so a CASE replaces three filtered
    copies and their anti-join. That holds while (hhid, interview_id, roster_id) is
    unique; ``household_afe(..., unique_person=False)`` keeps the join for other input.
    A person in no group (an infant with an unknown birth month) gets NULLs.
    """
    sex, age = F.col("sex"), F.col("age")
    infant = F.coalesce(is_under2(), F.lit(False))
    group = (F.when(infant, F.lit("under2"))
             .when((age >= 2) & (age < 18), F.lit("child"))
             .when(age >= 18, F.lit("adult")))
    kcal = (F.when(infant, kcal_under2(age_months()))
            .when((age >= 2) & (age < 18), kcal_child(sex, age, fix_f15))
            .when(age >= 18, kcal_adult(sex, age)))
    return df.withColumns({"grp": group, "afe": person_afe(kcal)})


def household_afe(df: DataFrame, unique_person: bool = True, fix_f15: bool = False) -> DataFrame:
    """AFE per household with at least one person in an age group."""
    if unique_person:
        # Households are filtered after the sum: a filter on the group would be pushed
        # down to the scan as one long CASE and be evaluated twice.
        sums = with_person_afe(df, fix_f15).groupBy("hhid").agg(
            F.count("grp").alias("_n"), total(F.col("afe")).alias("afe"))
        return sums.filter(F.col("_n") > 0).drop("_n")
    u2 = under2(df)
    sex, age = F.col("sex"), F.col("age")
    people = (
        u2.select("hhid", person_afe(kcal_under2(F.col("age_months"))).alias("afe"))
        .unionByName(children(df, u2).select("hhid", person_afe(kcal_child(sex, age, fix_f15)).alias("afe")))
        .unionByName(adults(df).select("hhid", person_afe(kcal_adult(sex, age)).alias("afe")))
    )
    return people.groupBy("hhid").agg(total(F.col("afe")).alias("afe"))


def unassigned_people(df: DataFrame) -> DataFrame:
    """How many people fall into no age group, or have no energy need in theirs."""
    people = with_person_afe(df)
    return people.agg(F.count_if(F.col("grp").isNull()).alias("no_group"),
                      F.count_if(F.col("grp").isNotNull() & F.col("afe").isNull()).alias("no_need"))


def household_information(df: DataFrame, fix_f15: bool = False) -> DataFrame:
    """Household attributes and AFE, one row per household.

    People are summed by household and attributes first, a hash aggregate that leaves a row or
    a few per household; only those are sorted for the smallest attribute row. Both steps
    need the household's one shuffle, and no join. A household with nobody in an age group
    keeps a missing AFE.
    """
    people = with_person_afe(df, fix_f15)
    alike = people.groupBy("hhid", *HH_ATTRIBUTES).agg(F.sum("afe").alias("_afe"), F.count("grp").alias("_grouped"))
    grouped = alike.groupBy("hhid").agg(
        F.min(F.struct(*HH_ATTRIBUTES)).alias("_first"),
        F.when(F.sum("_grouped") > 0, total(F.col("_afe"))).alias("afe"),
    )
    return grouped.select("hhid", *[F.col("_first")[c].alias(c) for c in HH_ATTRIBUTES], "afe")


def household_information_joined(df: DataFrame, fix_f15: bool = False) -> DataFrame:
    """The same for rosters whose person key repeats (anti-join form)."""
    first = first_per_key(df.select("hhid", *HH_ATTRIBUTES), "hhid", HH_ATTRIBUTES)
    return na_join(first, household_afe(df, unique_person=False, fix_f15=fix_f15), "hhid")


def prepare_roster(roster: DataFrame, dates: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Raw roster -> labelled, dated and cleaned roster."""
    return recode_sentinel(clean_birth(attach_date(decode_roster(roster, regions), dates)))
