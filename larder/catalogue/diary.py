"""Cleaning the food diary, step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import params
from larder.catalogue import query, rounded
from larder.functions.missing import outside
from larder.operators import cleaning, sketches
from larder.operators.accounting import Account
from larder.operators.joins import na_join
from larder.operators.ordering import quantiles_exact
from larder.sources.adapters import EXCLUDED_ITEMS, ISO3, SURVEY
from larder.sources.staging import stage


def _daily(t):
    return cleaning.daily_average(cleaning.exclude_items(cleaning.to_grams(t.diary()), EXCLUDED_ITEMS))


def _households(t):
    return cleaning.crosswalk(t.persons(), t.hh())


def _scaled(t):
    return cleaning.scaled_diary(t.diary(), t.edible(), _households(t), EXCLUDED_ITEMS)


def _blanked(t, k):
    scaled = stage(_scaled(t).select("interview_id", "hhid", "item_code", "quantity_g", "afe"))
    return cleaning.null_outliers(scaled, cleaning.log_cutpoint(scaled, k=k))


@query("unit_to_grams", "diary", """
    SELECT interview_id, item_code, unit, quantity * CASE WHEN unit IN (2, 4) THEN 1000e0
           WHEN unit IN (7, 8) THEN 55e0 ELSE 1e0 END AS quantity FROM diary""")
def unit_to_grams(t):
    return cleaning.to_grams(t.diary())


@query("exclude_items", "diary", """
    SELECT item_code, count(*) AS n_rows, round(sum(quantity), 3) AS quantity FROM diary
    WHERE item_code IS NULL OR item_code NOT IN (1, 2, 3) GROUP BY item_code""")
def exclude_items(t):
    kept = cleaning.exclude_items(t.diary(), EXCLUDED_ITEMS)
    return rounded(kept.groupBy("item_code").agg(F.count("*").alias("n_rows"), F.sum("quantity").alias("quantity")), 3)


@query("daily_quantity", "daily", "SELECT interview_id, item_code, round(quantity_g, 6) AS quantity_g FROM daily")
def daily_quantity(t):
    return rounded(_daily(t))


@query("edible_portion", "portioned", """
    SELECT interview_id, item_code, round(edible_portion, 6) AS edible_portion, round(quantity_g, 6) AS quantity_g
    FROM portioned""")
def edible_portion(t):
    return rounded(cleaning.edible(_daily(t), t.edible()))


@query("household_crosswalk", "xwalk", "SELECT hhid, afe, interview_id FROM xwalk")
def household_crosswalk(t):
    return _households(t)


@query("per_afe_range", "scaled", """
    SELECT interview_id, hhid, item_code, round(quantity_g, 6) AS quantity_g FROM scaled""")
def per_afe_range(t):
    return rounded(_scaled(t).select("interview_id", "hhid", "item_code", "quantity_g"))


@query("log_cutpoints", "cut", "SELECT item_code, round(cut3, 6) AS cutpoint FROM cut")
def log_cutpoints(t):
    return rounded(cleaning.log_cutpoint(_scaled(t)))


@query("log_cutpoints_1sd", "cut", "SELECT item_code, round(cut1, 6) AS cutpoint FROM cut")
def log_cutpoints_1sd(t):
    return rounded(cleaning.log_cutpoint(_scaled(t), k=1))


@query("outliers_nulled", "blanked", """
    SELECT interview_id, hhid, item_code, round(g3, 6) AS quantity_g FROM blanked""")
def outliers_nulled(t):
    return rounded(_blanked(t, 3).select("interview_id", "hhid", "item_code", "quantity_g"))


@query("outliers_nulled_1sd", "blanked", """
    SELECT interview_id, hhid, item_code, round(g1, 6) AS quantity_g FROM blanked""")
def outliers_nulled_1sd(t):
    return rounded(_blanked(t, 1).select("interview_id", "hhid", "item_code", "quantity_g"))


@query("impute_median", "filled", """
    SELECT interview_id, hhid, item_code, round(f1, 6) AS quantity_g FROM filled""")
def impute_median(t):
    """At one standard deviation, where a fifth of the values are filled."""
    filled = cleaning.impute_median(stage(_blanked(t, 1)))
    return rounded(filled.select("interview_id", "hhid", "item_code", "quantity_g"))


@query("row_accounting", "diary portioned xwalk scaled blanked filled", """
    SELECT 'listed item' AS rule, 'dropped' AS effect, count(*) AS n_rows, CAST(count(*) FILTER (item_code IN (1, 2, 3)) AS BIGINT) AS n_changed FROM diary
    UNION ALL SELECT 'quantity out of range', 'dropped', count(*), count(*) - (SELECT count(*) FROM scaled)
    FROM portioned p LEFT JOIN xwalk x ON p.interview_id IS NOT DISTINCT FROM x.interview_id
    UNION ALL SELECT 'outlier', 'blanked', count(*), count(raw_g) - count(g1) FROM blanked
    UNION ALL SELECT 'median', 'filled', count(*), (SELECT count(f1) FROM filled) - count(g1) FROM blanked""")
def row_accounting(t):
    """What each rule of the cleaning job drops, blanks and fills, counted while the job runs."""
    account = Account()
    kept = account.keep(cleaning.to_grams(t.diary()), "listed item", outside(F.col("item_code"), EXCLUDED_ITEMS))
    scaled = cleaning.per_afe(cleaning.edible(cleaning.daily_average(kept), t.edible()), _households(t))
    in_range = (F.col("quantity_g") != 0) & (F.col("quantity_g") <= params.MAX_GRAMS_PER_AFE)
    scaled = stage(account.keep(scaled, "quantity out of range", in_range).select("interview_id", "hhid", "item_code", "quantity_g"))
    cut = na_join(scaled, cleaning.log_cutpoint(scaled, k=1), "item_code")
    blanked = stage(account.blank(cut, "outlier", "quantity_g", F.log10("quantity_g") > F.col("cutpoint")).drop("cutpoint"))
    medians = quantiles_exact(blanked, "quantity_g", [0.5], ["hhid"], by=["item_code"], names=["median"])
    stage(account.fill(na_join(blanked, medians, "item_code"), "median", "quantity_g", F.col("median")))
    return account.table(t.spark)


@query("sketch_medians", "scaled", """
    SELECT item_code, count(quantity_g) AS n, round(quantile_disc(quantity_g, 0.5), 6) AS median, round(quantile_disc(quantity_g, 0.9), 6) AS p90
    FROM scaled WHERE quantity_g IS NOT NULL GROUP BY item_code""")
def sketch_medians(t):
    """Quantiles of items from the stored sketches of two diary rounds; no item here has more values than a sketch keeps."""
    scaled = stage(_scaled(t).select("interview_id", "item_code", "quantity_g"))
    rounds = [stage(sketches.sketched(scaled.filter(F.crc32(F.col("interview_id").cast("string")) % 2 == r))) for r in (0, 1)]
    return rounded(sketches.quantiles(sketches.merged(*rounds), [0.5, 0.9], ["median", "p90"]))


@query("clean_consumption", "filled", f"""
    SELECT '{ISO3}' AS iso3, '{SURVEY}' AS survey, hhid, item_code, round(f3 * afe, 6) AS quantity_g,
           round(f3 * afe / 100, 6) AS quantity_100g FROM filled""")
def clean_consumption(t):
    return rounded(cleaning.clean_consumption(t.diary(), t.edible(), _households(t), ISO3, SURVEY, EXCLUDED_ITEMS))
