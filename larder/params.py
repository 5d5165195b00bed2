"""Fixed parameter values and their small DataFrames.

Everything here is a published standard or an agreed code list. The values are
fixed: results depend on them digit by digit. Frames built from them have as many
rows as the literals below, so they are the only frames this package broadcasts
by hint, next to single-row aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Average requirement per adult-female-equivalent and day.
REQUIREMENT: dict[str, float] = {
    "energy_kcal": 2100.0,
    "vita_rae_mcg": 490.0,
    "thia_mg": 0.9,
    "ribo_mg": 1.3,
    "niac_mg": 11.0,
    "vitb6_mg": 1.3,
    "folate_mcg": 250.0,
    "vitb12_mcg": 2.0,
    "fe_mg": 22.4,
    "ca_mg": 860.0,
    "zn_mg": 10.2,
}
NUTRIENTS: list[str] = list(REQUIREMENT)

# Coefficient of variation of the requirement.
VARIATION: dict[str, float] = {
    "vita_rae_mcg": 0.20, "folate_mcg": 0.10, "vitb12_mcg": 0.10, "zn_mg": 0.125,
}

# Nutrient sets used by the standard reports.
CORE_NUTRIENTS = ["vita_rae_mcg", "folate_mcg", "vitb12_mcg", "fe_mg", "zn_mg"]
CUT_POINT_NUTRIENTS = ["vita_rae_mcg", "folate_mcg", "vitb12_mcg", "zn_mg"]
MAR4_NUTRIENTS = ["vita_rae_mcg", "vitb12_mcg", "fe_mg", "zn_mg"]
LONG_NUTRIENTS = ["vita_rae_mcg", "thia_mg", "ribo_mg", "vitb12_mcg", "zn_mg", "ca_mg"]

# Iron inadequacy probability per intake band, and the inclusive upper
# edge (mg) of every band but the last, by bioavailability (%).
IRON_PROBABILITY = (1.0, 0.96, 0.93, 0.85, 0.75, 0.65, 0.55, 0.45, 0.35, 0.25, 0.15, 0.08, 0.04, 0.0)
IRON_EDGES: dict[int, tuple[float, ...]] = {
    5: (15.0, 16.7, 18.7, 21.4, 23.6, 25.7, 27.8, 30.2, 33.2, 37.3, 45.0, 53.5, 63.0),
    10: (7.5, 8.4, 9.4, 10.7, 11.8, 12.9, 13.9, 15.1, 16.6, 18.7, 22.5, 26.7, 31.5),
    15: (5.0, 5.6, 6.2, 7.1, 7.9, 8.6, 9.3, 10.1, 11.1, 12.4, 15.0, 17.8, 21.0),
}

# Grams per reported unit (units not listed count as grams already),
# item codes that are not food, and the reference period in days.
UNIT_GRAMS: dict[int, float] = {2: 1000.0, 4: 1000.0, 7: 55.0, 8: 55.0}
NON_FOOD_ITEMS = (122101, 122102, 0)
DIARY_DAYS = 14
MAX_GRAMS_PER_AFE = 5000.0

# Daily energy needs (kcal) behind the adult-female-equivalent.
KCAL_PER_AFE = 2291.0
ACTIVITY_LEVEL = 1.76
MALE_KG, FEMALE_KG = 65.0, 55.0
# Under two: (first month, last month, kcal); open ends are None.
INFANT_KCAL = ((None, 2, 0.0), (3, 5, 76.0), (6, 8, 269.0), (9, 11, 451.0), (12, None, 746.0))
# Ages 2, 3, ... 17. Girls aged exactly 15 have no entry in the source table.
BOY_KCAL = (1125, 1250, 1350, 1475, 1575, 1700, 1825, 1975, 2150, 2350, 2550, 2775, 3000, 3175, 3325, 3400)
GIRL_KCAL = (1050, 1150, 1250, 1325, 1425, 1550, 1700, 1850, 2000, 2150, 2275, 2375, 2450)
OLDER_GIRL_KCAL = 2500.0
# Adults: (from age, slope per kg, intercept) of basal metabolic rate.
MALE_BMR = ((18, 15.057, 692.2), (30, 11.472, 873.1), (60, 11.711, 587.7))
FEMALE_BMR = ((18, 14.818, 486.6), (30, 8.126, 845.6), (60, 9.082, 658.5))

# Code lists.
RESIDENCE_LABELS = {1: "Rural", 2: "Urban"}
SEX_LABELS = {1: "Male", 2: "Female"}
REGION_LABELS = {
    1: "Dodoma", 2: "Arusha", 3: "Kilimanjaro", 4: "Tanga", 5: "Morogoro", 6: "Pwani",
    7: "Dar Es Salaam", 8: "Lindi", 9: "Mtwara", 10: "Ruvuma", 11: "Iringa", 12: "Mbeya",
    13: "Singida", 14: "Tabora", 15: "Rukwa", 16: "Kigoma", 17: "Shinyanga", 18: "Kagera",
    19: "Mwanza", 20: "Mara", 21: "Manyara", 22: "Njombe", 23: "Katavi", 24: "Simiyu",
    25: "Geita", 26: "Songwe",
}
EXCLUDED_REGIONS = "Unguja|Pemba|Mjini"
REGION_SPELLING = {"Dar-es-salaam": "Dar Es Salaam"}

# Food groups of the composition table -> reported group.
OTHER_FOODS = "Other foods"
FOOD_GROUPS = {
    "grains_roots_tubers": "Grains, roots and tubers",
    "misc": OTHER_FOODS,
    "nuts_seeds": "Nuts, seeds and pulses",
    "pulses": "Nuts, seeds and pulses",
    "other_veg": "Other fruits and vegetables",
    "other_fruit": "Other fruits and vegetables",
    "meat_poultry_fish": "Animal source foods",
    "eggs": "Animal source foods",
    "dairy": "Animal source foods",
    "green_leafy_veg": "Vitamin A rich fruits and vegetables",
    "vita_fruit_veg": "Vitamin A rich fruits and vegetables",
}
NUTRITIOUS_GROUPS = (
    "Nuts, seeds and pulses",
    "Other fruits and vegetables",
    "Animal source foods",
    "Vitamin A rich fruits and vegetables",
)

# Fortification standards (level), processing losses and food vehicles.
MAIZE_LEVELS = {"vitb12_mcg": 0.5, "fe_mg": 1.5, "zn_mg": 2.25, "folate_mcg": 150.0}
WHEAT_LEVELS = {"vitb12_mcg": 1.5, "fe_mg": 4.0, "zn_mg": 4.0, "folate_mcg": 300.0}
OIL_LEVELS = {"vita_rae_mcg": 1700.0}
FLOUR_LOSSES = {"vitb12_mcg": 0.15, "fe_mg": 0.0, "zn_mg": 0.0, "folate_mcg": 0.17}
OIL_LOSSES = {"vita_rae_mcg": 0.32}
MAIZE_ITEMS = {111504: 1.0}
WHEAT_ITEMS = {
    111506: 1.0, 111201: 0.75, 111202: 0.75, 111203: 0.75, 111204: 0.75, 111205: 0.75,
    111206: 0.75, 111207: 0.75, 111299: 0.75, 111402: 0.33, 111401: 0.635, 111405: 0.277,
    111208: 0.63,
}
OIL_ITEMS = (115101, 115401, 115402, 115403, 115404, 115405)

# Supplementation survey codes.
UNKNOWN_MONTH_OR_DAY, UNKNOWN_YEAR, ASSUMED_DAY = 98, 9998, 15
DAY_COUNT_ORIGIN, DAY_COUNT_OFFSET, DAYS_PER_MONTH = "1960-01-01", 21916, 30.4375
COVERAGE_TARGET = 80


def literal_frame(spark: SparkSession, **columns) -> DataFrame:
    """A frame of literals, held in the plan itself (an Arrow table becomes a local relation)."""
    return spark.createDataFrame(pa.table(columns))


def requirement_frame(spark: SparkSession, requirement: Mapping[str, float] = REQUIREMENT) -> DataFrame:
    """(nutrient, ear_value)"""
    return literal_frame(spark, nutrient=pa.array(list(requirement), pa.string()),
                         ear_value=pa.array(list(requirement.values()), pa.float64()))


def variation_frame(spark: SparkSession, variation: Mapping[str, float] = VARIATION) -> DataFrame:
    """(nutrient, cv)"""
    return literal_frame(spark, nutrient=pa.array(list(variation), pa.string()),
                         cv=pa.array(list(variation.values()), pa.float64()))


def labels_frame(spark: SparkSession, labels: Mapping[int, str]) -> DataFrame:
    """Value labels of a coded column as (code, label)."""
    return literal_frame(spark, code=pa.array(list(labels), pa.int32()),
                         label=pa.array(list(labels.values()), pa.string()))


def food_group_frame(spark: SparkSession, groups: Mapping[str, str] = FOOD_GROUPS) -> DataFrame:
    """(food_group, food_group_new)"""
    return literal_frame(spark, food_group=pa.array(list(groups), pa.string()),
                         food_group_new=pa.array(list(groups.values()), pa.string()))
