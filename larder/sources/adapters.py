"""Survey-shaped views over the star-schema test tables.

Customers stand for households, orders for household members, parts for food items,
line items for the food diary, events for children. ``Tables`` builds the views with
the DataFrame API; ``VIEWS`` says the same in SQL for the comparison engine, written
separately so that neither can hide a slip in the other.

Nutrient densities are scaled by the item price so that no intake falls exactly on a
band edge, where two engines could disagree over the last bit of a sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder import params
from larder.operators.scenario import Vehicle
from larder.sources.tables import Survey

ISO3, SURVEY = "ZZZ", "demo"
URBAN_SEGMENTS = ("BUILDING", "MACHINERY")
EXCLUDED_ITEMS = (1, 2, 3)
DROP_REGIONS, RESPELL = "NATION_2[34]", {"NATION_7": "NATION_07"}
# Food type of the item -> reported group; one type has no entry on purpose.
TYPE_GROUPS = {
    "ECONOMY": "Grains, roots and tubers",
    "MEDIUM": "Nuts, seeds and pulses",
    "PROMO": "Animal source foods",
    "STANDARD": "Other fruits and vegetables",
    "LARGE": "Vitamin A rich fruits and vegetables",
}
PRICE_SCALE = 953.0


_SCHEMAS: dict[str, T.StructType] = {}


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    path: str

    def read(self, name: str) -> DataFrame:
        """A table, its footer read once per path: later reads know the schema."""
        path = f"{self.path.rstrip('/')}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def hh(self) -> DataFrame:
        joined = self.read("customer").join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("c_custkey").alias("hhid"), _interview("c_custkey"), F.col("n_name").alias("adm1"),
            F.when(F.col("c_mktsegment").isin(*URBAN_SEGMENTS), F.lit("Urban")).otherwise(F.lit("Rural")).alias("res"),
            (F.col("c_acctbal") + 1000).alias("survey_wgt"),
            (1.0 + (F.col("c_custkey") % 7) * 0.5).alias("afe"), F.col("c_acctbal").alias("pc_expenditure"))

    def fct(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        price = F.col("p_retailprice") / PRICE_SCALE
        density = {
            "vita_rae_mcg": F.when(F.col("p_type").isin("LARGE", "PROMO"), size * 18.0).otherwise(F.lit(0.0)),
            "thia_mg": (key % 15) * 3e-2,
            "ribo_mg": (size % 8) * 9e-2,
            "niac_mg": size * 11e-2,
            "vitb6_mg": (key % 12) * 6e-2,
            "folate_mcg": size * 3.0,
            "vitb12_mcg": (key % 10) * 12e-2,
            "fe_mg": size * 2e-1,
            "ca_mg": size * 8.5,
            "zn_mg": (key % 20) * 3e-1,
        }
        return self.read("part").select(
            key.alias("item_code"), F.col("p_name").alias("item_name"), F.col("p_type").alias("food_group"),
            (F.col("p_retailprice") / 3).alias("energy_kcal"),
            *[(price * d).alias(n) for n, d in density.items()])

    def cons(self) -> DataFrame:
        return (self.read("lineitem").join(self.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
                .select(F.col("o_custkey").alias("hhid"), F.col("l_partkey").alias("item_code"),
                        F.col("l_quantity").alias("quantity_g"), (F.col("l_quantity") / 100).alias("quantity_100g")))

    def survey(self) -> Survey:
        return Survey(self.hh(), self.cons(), self.fct())

    def diary(self) -> DataFrame:
        lines = self.read("lineitem").join(self.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.select(
            _interview("o_custkey"), F.col("l_partkey").alias("item_code"),
            ((F.col("l_orderkey") + F.col("l_linenumber")) % 10).cast("int").alias("unit"),
            F.when(F.col("l_orderkey") % 101 == 0, F.lit(0.0)).otherwise(F.col("l_quantity") * 4).alias("quantity"))

    def edible(self) -> DataFrame:
        """No portion is known for one food type."""
        return self.read("part").filter(F.col("p_type") != "LARGE").select(
            F.col("p_partkey").alias("item_code"), (0.5 + (F.col("p_size") % 6) * 1e-1).alias("edible_portion"))

    def persons(self) -> DataFrame:
        key = F.col("o_orderkey")
        joined = (self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
                  .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")))
        age = (F.when(key % 97 == 0, F.lit(-9998)).when(key % 11 == 0, key % 3).otherwise(key % 79))
        born = (F.when(key % 53 == 0, F.lit(2019)).when(key % 97 == 0, F.lit(2018))
                .when(key % 11 == 0, 2018 - key % 3).otherwise(2018 - key % 79))
        return joined.select(
            F.col("o_custkey").alias("hhid"), _interview("o_custkey"), key.alias("roster_id"),
            (F.col("n_nationkey") + 1).cast("int").alias("adm1"), (1 + key % 2).cast("int").alias("sex"),
            F.when(F.col("c_mktsegment").isin(*URBAN_SEGMENTS), F.lit(2)).otherwise(F.lit(1)).alias("res"),
            age.cast("int").alias("age"), born.cast("int").alias("year_birth"),
            (1 + F.shiftright(key, 1) % 13).cast("int").alias("month_birth"),
            F.lit(2018).alias("year"), (1 + F.col("o_custkey") % 12).cast("int").alias("month"),
            (F.col("c_acctbal") + 1000).alias("survey_wgt"))

    def children(self) -> DataFrame:
        key, day = F.col("event_id"), F.col("ts").cast("date")
        month = (F.year(day) - 1900) * 12 + F.month(day)
        days = F.datediff(day, F.lit(params.DAY_COUNT_ORIGIN).cast("date")) + params.DAY_COUNT_OFFSET
        unknown = F.lit(None).cast("int")
        recall = (F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 8)
                  .when(F.col("event_type") == "signup", unknown).otherwise(0))
        return self.read("events").select(
            "event_id", F.col("user_id").alias("v001"),
            (F.floor(F.col("value") * 10000).cast("bigint") + 1).alias("v005"),
            (1 + F.col("user_id") % 25).cast("int").alias("v024"), month.alias("v008"), days.alias("v008a"),
            (month - key % 72).cast("int").alias("b3"),
            F.when((F.col("event_type") == "error") & (key % 3 == 0), 0).otherwise(1).alias("b5"),
            F.when(key % 4 == 0, unknown).otherwise((key % 72).cast("int")).alias("b19"),
            F.when(key % 9 == 0, 98).when(key % 13 == 0, unknown).otherwise((1 + key % 31).cast("int")).alias("h33d"),
            F.when(key % 17 == 0, 98).otherwise((1 + key % 12).cast("int")).alias("h33m"),
            F.when(key % 19 == 0, 9998).otherwise(2023).alias("h33y"), recall.alias("h34"))

    def hh_date(self) -> DataFrame:
        return self.read("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("_first")).select(
            _interview("o_custkey"), F.date_format("_first", "yyyyMMdd").alias("date"))

    def cons_agg(self) -> DataFrame:
        sums = self.read("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("_sum"))
        return sums.select(_interview("o_custkey"), (F.col("_sum") / 12).alias("cons_aeq_adj"),
                           (F.col("_sum") / 11).alias("exp_aeq_month"))

    def region_codes(self) -> DataFrame:
        return self.read("nation").select((F.col("n_nationkey") + 1).alias("code"), F.lower("n_name").alias("label"))

    def region_dim(self) -> DataFrame:
        return self.read("nation").select(F.col("n_name").alias("adm1"))

    def food_group_map(self) -> DataFrame:
        return params.food_group_frame(self.spark, TYPE_GROUPS)

    def vehicles(self) -> list[Vehicle]:
        """Two flours that share some items, and an oil."""
        part = self.read("part")
        key, kind, size = F.col("p_partkey").alias("item_code"), F.col("p_type"), F.col("p_size")
        maize = part.filter(kind == "MEDIUM").select(key, F.lit(1.0).alias("fraction"))
        wheat = part.filter((kind == "PROMO") | ((kind == "MEDIUM") & (size <= 20))).select(
            key, F.lit(0.75).alias("fraction"))
        oil = part.filter(kind == "SMALL").select(key, F.lit(1.0).alias("fraction"))
        return [Vehicle(maize, params.MAIZE_LEVELS, params.FLOUR_LOSSES),
                Vehicle(wheat, params.WHEAT_LEVELS, params.FLOUR_LOSSES),
                Vehicle(oil, params.OIL_LEVELS, params.OIL_LOSSES)]


def _interview(column: str):
    return F.concat(F.lit("I"), F.col(column).cast("string")).alias("interview_id")


# The same views in SQL, with the steps most queries share. name -> (views it needs, text)
_N = params.NUTRIENTS

VIEWS: dict[str, tuple[list[str], str]] = {
    "hh": ([], """
        SELECT c_custkey AS hhid, 'I' || c_custkey AS interview_id, n_name AS adm1,
               CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Urban' ELSE 'Rural' END AS res,
               c_acctbal + 1000 AS survey_wgt, CAST(1.0 + (c_custkey % 7) * 0.5 AS DOUBLE) AS afe,
               c_acctbal AS pc_expenditure
        FROM customer
        JOIN nation ON c_nationkey = n_nationkey"""),
    "fct": ([], """
        SELECT p_partkey AS item_code, p_name AS item_name, p_type AS food_group,
               p_retailprice / 3 AS energy_kcal,
               p_retailprice / 953 * CASE WHEN p_type IN ('LARGE', 'PROMO') THEN p_size * 18e0 ELSE 0e0 END AS vita_rae_mcg,
               p_retailprice / 953 * ((p_partkey % 15) * 3e-2) AS thia_mg,
               p_retailprice / 953 * ((p_size % 8) * 9e-2) AS ribo_mg,
               p_retailprice / 953 * (p_size * 11e-2) AS niac_mg,
               p_retailprice / 953 * ((p_partkey % 12) * 6e-2) AS vitb6_mg,
               p_retailprice / 953 * (p_size * 3e0) AS folate_mcg,
               p_retailprice / 953 * ((p_partkey % 10) * 12e-2) AS vitb12_mcg,
               p_retailprice / 953 * (p_size * 2e-1) AS fe_mg,
               p_retailprice / 953 * (p_size * 85e-1) AS ca_mg,
               p_retailprice / 953 * ((p_partkey % 20) * 3e-1) AS zn_mg
        FROM part"""),
    "cons": ([], """
        SELECT o_custkey AS hhid, l_partkey AS item_code, l_quantity AS quantity_g, l_quantity / 100 AS quantity_100g
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "diary": ([], """
        SELECT 'I' || o_custkey AS interview_id, l_partkey AS item_code,
               CAST((l_orderkey + l_linenumber) % 10 AS INTEGER) AS unit,
               CASE WHEN l_orderkey % 101 = 0 THEN 0e0 ELSE l_quantity * 4 END AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "edible": ([], """
        SELECT p_partkey AS item_code, 5e-1 + (p_size % 6) * 1e-1 AS edible_portion
        FROM part WHERE p_type <> 'LARGE'"""),
    "persons": ([], """
        SELECT o_custkey AS hhid, 'I' || o_custkey AS interview_id, o_orderkey AS roster_id,
               CAST(n_nationkey + 1 AS INTEGER) AS adm1, CAST(1 + o_orderkey % 2 AS INTEGER) AS sex,
               CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 2 ELSE 1 END AS res,
               CAST(CASE WHEN o_orderkey % 97 = 0 THEN -9998 WHEN o_orderkey % 11 = 0 THEN o_orderkey % 3
                         ELSE o_orderkey % 79 END AS INTEGER) AS age,
               CAST(CASE WHEN o_orderkey % 53 = 0 THEN 2019 WHEN o_orderkey % 97 = 0 THEN 2018
                         WHEN o_orderkey % 11 = 0 THEN 2018 - o_orderkey % 3
                         ELSE 2018 - o_orderkey % 79 END AS INTEGER) AS year_birth,
               CAST(1 + (o_orderkey >> 1) % 13 AS INTEGER) AS month_birth,
               2018 AS year, CAST(1 + o_custkey % 12 AS INTEGER) AS month, c_acctbal + 1000 AS survey_wgt
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
    "roster": (["persons", "region_labels"], """
        SELECT p.hhid, p.interview_id, p.roster_id, l.label AS adm1,
               CASE p.sex WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS sex,
               CASE p.res WHEN 1 THEN 'Rural' WHEN 2 THEN 'Urban' END AS res,
               p.age, p.year_birth, p.month_birth, p.year, p.month, p.survey_wgt
        FROM persons p LEFT JOIN region_labels l ON p.adm1 = l.code"""),
    "region_labels": ([], "SELECT * FROM (VALUES "
                      + ", ".join(f"({c}, '{n}')" for c, n in params.REGION_LABELS.items()) + ") AS v(code, label)"),
    "dated": (["roster"], """
        SELECT * REPLACE (CASE WHEN NOT (year_birth > year) THEN year_birth END AS year_birth) FROM roster"""),
    "born": (["dated"], """
        SELECT * REPLACE (CASE WHEN NOT (year_birth = year AND month_birth > month) AND NOT (month_birth > 12)
                               THEN month_birth END AS month_birth) FROM dated"""),
    "people": (["born"], """
        SELECT * REPLACE (CASE WHEN age = -9998 THEN 0 ELSE age END AS age) FROM born"""),
    "under2": (["people"], """
        SELECT * FROM (SELECT hhid, interview_id, roster_id, sex,
                              (year - year_birth) * 12 + (month - month_birth) AS age_months
                       FROM people WHERE age <= 2) WHERE age_months <= 24"""),
    "children_2_17": (["people", "under2"], """
        SELECT hhid, interview_id, roster_id, sex, age FROM people p
        WHERE age >= 2 AND age < 18 AND NOT EXISTS (
            SELECT 1 FROM under2 u WHERE u.hhid IS NOT DISTINCT FROM p.hhid
            AND u.interview_id IS NOT DISTINCT FROM p.interview_id
            AND u.roster_id IS NOT DISTINCT FROM p.roster_id)"""),
    "kcal": (["people", "under2", "children_2_17"], """
        SELECT hhid, roster_id, 'under2' AS grp, CASE WHEN age_months <= 2 THEN 0e0
                    WHEN age_months BETWEEN 3 AND 5 THEN 76e0 WHEN age_months BETWEEN 6 AND 8 THEN 269e0
                    WHEN age_months BETWEEN 9 AND 11 THEN 451e0 WHEN age_months >= 12 THEN 746e0 END AS kcal FROM under2
        UNION ALL
        SELECT hhid, roster_id, 'child', CASE
               WHEN sex = 'Male' THEN ([1125e0, 1250, 1350, 1475, 1575, 1700, 1825, 1975, 2150, 2350, 2550, 2775, 3000,
                                        3175, 3325, 3400])[age - 1]
               WHEN sex = 'Female' AND age > 15 AND age < 18 THEN 2500e0
               WHEN sex = 'Female' AND age < 15 THEN ([1050e0, 1150, 1250, 1325, 1425, 1550, 1700, 1850, 2000, 2150,
                                                       2275, 2375, 2450])[age - 1] END
        FROM children_2_17
        UNION ALL
        SELECT hhid, roster_id, 'adult', CASE sex
               WHEN 'Male' THEN CASE WHEN age < 30 THEN 15.057e0 * 65 + 692.2e0 WHEN age < 60 THEN 11.472e0 * 65 + 873.1e0
                                     ELSE 11.711e0 * 65 + 587.7e0 END
               WHEN 'Female' THEN CASE WHEN age < 30 THEN 14.818e0 * 55 + 486.6e0 WHEN age < 60 THEN 8.126e0 * 55 + 845.6e0
                                       ELSE 9.082e0 * 55 + 658.5e0 END END * 1.76e0
        FROM people WHERE age >= 18"""),
    "hh_afe": (["kcal"], "SELECT hhid, coalesce(sum(kcal / 2291e0), 0e0) AS afe FROM kcal GROUP BY hhid"),
    "hh_info": (["people", "hh_afe"], """
        SELECT f.hhid, f.adm1, f.res, f.survey_wgt, f.year, f.month, a.afe FROM (
            SELECT *, row_number() OVER (PARTITION BY hhid ORDER BY adm1 NULLS FIRST, res NULLS FIRST,
                                         survey_wgt NULLS FIRST, year NULLS FIRST, month NULLS FIRST) AS rn
            FROM people) f LEFT JOIN hh_afe a ON f.hhid IS NOT DISTINCT FROM a.hhid WHERE f.rn = 1"""),
    "kids": ([], """
        SELECT event_id, user_id AS v001, CAST(floor(value * 10000) AS BIGINT) + 1 AS v005,
               CAST(1 + user_id % 25 AS INTEGER) AS v024, CAST((year(ts) - 1900) * 12 + month(ts) AS INTEGER) AS v008,
               CAST(date_diff('day', DATE '1960-01-01', CAST(ts AS DATE)) + 21916 AS INTEGER) AS v008a,
               CAST((year(ts) - 1900) * 12 + month(ts) - event_id % 72 AS INTEGER) AS b3,
               CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 0 ELSE 1 END AS b5,
               CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 72 END AS INTEGER) AS b19,
               CAST(CASE WHEN event_id % 9 = 0 THEN 98 WHEN event_id % 13 = 0 THEN NULL
                         ELSE 1 + event_id % 31 END AS INTEGER) AS h33d,
               CAST(CASE WHEN event_id % 17 = 0 THEN 98 ELSE 1 + event_id % 12 END AS INTEGER) AS h33m,
               CASE WHEN event_id % 19 = 0 THEN 9998 ELSE 2023 END AS h33y,
               CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 8 WHEN 'signup' THEN NULL ELSE 0 END AS h34
        FROM events"""),
    "vas": (["kids"], """
        SELECT *, CASE WHEN eligible_child = 0 THEN NULL WHEN h34 = 1 THEN 1
                       WHEN months_since_vita <= 6 THEN 1 ELSE 0 END AS vas_child
        FROM (SELECT *, (v008a - (date_diff('day', DATE '1960-01-01', dose_date) + 21916)) / 30.4375e0 AS months_since_vita
              FROM (SELECT *, v005 / 1000000 AS wt, v024 AS adm1, coalesce(b19, v008 - b3) AS age,
                           CAST(coalesce(b19, v008 - b3) >= 6 AND coalesce(b19, v008 - b3) <= 59 AND b5 = 1 AS INTEGER)
                               AS eligible_child,
                           CAST(try_strptime(nullif(h33y, 9998) || '-' || nullif(h33m, 98) || '-' ||
                                CASE WHEN h33d IS NULL OR h33d = 98 THEN 15 ELSE h33d END, '%Y-%m-%d') AS DATE) AS dose_date
                    FROM kids))"""),
    "hh_date": ([], """
        SELECT 'I' || o_custkey AS interview_id, strftime(min(o_orderdate), '%Y%m%d') AS date
        FROM orders GROUP BY o_custkey"""),
    "cons_agg": ([], """
        SELECT 'I' || o_custkey AS interview_id, sum(o_totalprice) / 12 AS cons_aeq_adj,
               sum(o_totalprice) / 11 AS exp_aeq_month FROM orders GROUP BY o_custkey"""),
    "per_hh": (["cons_agg", "persons"], """
        SELECT hhid, cons_aeq_adj, exp_aeq_month FROM (
            SELECT i.hhid, c.cons_aeq_adj, c.exp_aeq_month,
                   row_number() OVER (PARTITION BY i.hhid ORDER BY c.cons_aeq_adj NULLS FIRST,
                                      c.exp_aeq_month NULLS FIRST) AS rn
            FROM cons_agg c LEFT JOIN (SELECT DISTINCT hhid, interview_id FROM persons) i
                 ON c.interview_id IS NOT DISTINCT FROM i.interview_id) WHERE rn = 1"""),
    "daily": (["diary"], """
        SELECT interview_id, item_code, coalesce(sum(quantity * CASE WHEN unit IN (2, 4) THEN 1000e0
               WHEN unit IN (7, 8) THEN 55e0 ELSE 1e0 END), 0e0) / 14 AS quantity_g
        FROM diary WHERE item_code IS NULL OR item_code NOT IN (1, 2, 3) GROUP BY interview_id, item_code"""),
    "portioned": (["daily", "edible"], """
        SELECT d.interview_id, d.item_code, e.edible_portion,
               CASE WHEN e.edible_portion IS NOT NULL THEN d.quantity_g * e.edible_portion ELSE d.quantity_g END AS quantity_g
        FROM daily d LEFT JOIN edible e ON d.item_code IS NOT DISTINCT FROM e.item_code"""),
    "xwalk": (["hh", "persons"], """
        SELECT h.hhid, h.afe, i.interview_id FROM hh h LEFT JOIN (SELECT DISTINCT hhid, interview_id FROM persons) i
               ON h.hhid IS NOT DISTINCT FROM i.hhid"""),
    "scaled": (["portioned", "xwalk"], """
        SELECT * FROM (SELECT p.interview_id, p.item_code, x.hhid, x.afe, p.quantity_g / nullif(x.afe, 0) AS quantity_g
            FROM portioned p LEFT JOIN xwalk x ON p.interview_id IS NOT DISTINCT FROM x.interview_id)
        WHERE quantity_g <> 0 AND quantity_g <= 5000"""),
    "cut": (["scaled"], """
        SELECT item_code, avg(l) + 3 * stddev_samp(l) AS cut3, avg(l) + 1 * stddev_samp(l) AS cut1
        FROM (SELECT item_code, CASE WHEN quantity_g > 0 THEN log10(quantity_g) END AS l FROM scaled) GROUP BY item_code"""),
    "blanked": (["scaled", "cut"], """
        SELECT s.interview_id, s.hhid, s.item_code, s.afe, s.quantity_g AS raw_g,
               CASE WHEN log10(s.quantity_g) > c.cut3 THEN NULL ELSE s.quantity_g END AS g3,
               CASE WHEN log10(s.quantity_g) > c.cut1 THEN NULL ELSE s.quantity_g END AS g1
        FROM scaled s LEFT JOIN cut c ON s.item_code IS NOT DISTINCT FROM c.item_code"""),
    "filled": (["blanked"], """
        SELECT interview_id, hhid, item_code, afe, coalesce(g3, median(g3) OVER (PARTITION BY item_code)) AS f3,
               coalesce(g1, median(g1) OVER (PARTITION BY item_code)) AS f1 FROM blanked"""),
    "region_codes": ([], "SELECT n_nationkey + 1 AS code, lower(n_name) AS label FROM nation"),
    "region_dim": ([], "SELECT n_name AS adm1 FROM nation"),
    "regions": (["region_dim"], """
        SELECT CASE adm1 WHEN 'NATION_7' THEN 'NATION_07' ELSE adm1 END AS adm1
        FROM region_dim WHERE NOT regexp_matches(adm1, 'NATION_2[34]')"""),
    "type_groups": ([], "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TYPE_GROUPS.items())
                    + ") AS v(food_group, food_group_new)"),
    "intake": (["hh", "fct", "cons"], "SELECT s.hhid, "
               + ", ".join(f"s.{n} / nullif(h.afe, 0) AS {n}" for n in _N)
               + " FROM (SELECT c.hhid, " + ", ".join(f"coalesce(sum(f.{n} * c.quantity_100g), 0e0) AS {n}" for n in _N)
               + " FROM cons c LEFT JOIN fct f ON c.item_code IS NOT DISTINCT FROM f.item_code GROUP BY c.hhid) s"
               + " LEFT JOIN hh h ON s.hhid IS NOT DISTINCT FROM h.hhid"),
    "described": (["intake", "hh"], """
        SELECT i.*, h.adm1, h.res, h.survey_wgt FROM intake i LEFT JOIN hh h ON i.hhid IS NOT DISTINCT FROM h.hhid"""),
    "quintiles": (["hh"], """
        SELECT hhid, ntile(5) OVER (ORDER BY pc_expenditure, hhid) AS sep_quintile,
               ntile(5) OVER (PARTITION BY res ORDER BY pc_expenditure, hhid) AS res_quintile
        FROM hh WHERE pc_expenditure IS NOT NULL"""),
    "vehicle_maize": ([], "SELECT p_partkey AS item_code, 1e0 AS fraction FROM part WHERE p_type = 'MEDIUM'"),
    "vehicle_wheat": ([], """SELECT p_partkey AS item_code, 75e-2 AS fraction FROM part
        WHERE p_type = 'PROMO' OR (p_type = 'MEDIUM' AND p_size <= 20)"""),
    "vehicle_oil": ([], "SELECT p_partkey AS item_code, 1e0 AS fraction FROM part WHERE p_type = 'SMALL'"),
}


def with_views(body: str, *names: str) -> str:
    """``body`` behind the named views and whatever they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    if body.lstrip().upper().startswith("WITH "):
        body = f"SELECT * FROM ({body})"
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body
