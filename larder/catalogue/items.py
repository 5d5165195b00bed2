"""Food groups and single foods."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import params
from larder.catalogue import query, rounded
from larder.functions.nutrition import below_requirement
from larder.operators import contribution, food_groups
from larder.operators.intake import apparent_intake
from larder.plans.reports import energy_report
from larder.sources.staging import stage_path
from larder.sources.tables import write_report

CORE = params.CORE_NUTRIENTS
ZINC = "zn_mg"

QTY = """(SELECT c.item_code, coalesce(sum(c.quantity_100g / nullif(h.afe, 0)), 0e0) AS qty100g
          FROM cons c JOIN hh h ON c.hhid IS NOT DISTINCT FROM h.hhid GROUP BY c.item_code)"""
ENERGY = f"""(SELECT q.item_code, q.qty100g, f.food_group, f.energy_kcal * q.qty100g AS energy_kcal,
                     coalesce(g.food_group_new, 'Other foods') AS food_group_new
              FROM {QTY} q LEFT JOIN fct f ON q.item_code IS NOT DISTINCT FROM f.item_code
              LEFT JOIN type_groups g ON f.food_group = g.food_group)"""
GROUPED = f"(SELECT food_group_new, coalesce(sum(energy_kcal), 0e0) AS totalenergy_kcal FROM {ENERGY} GROUP BY 1)"
IN_NUTRITIOUS = "food_group_new IN (" + ", ".join(f"'{g}'" for g in params.NUTRITIOUS_GROUPS) + ")"
VIEWS = "hh cons fct type_groups"


def _energy(t):
    return food_groups.regroup(
        food_groups.item_energy(food_groups.item_quantity(t.cons(), t.hh()), t.fct()), t.food_group_map())


@query("item_quantity", "hh cons", f"SELECT item_code, round(qty100g, 6) AS qty100g FROM {QTY}")
def item_quantity(t):
    return rounded(food_groups.item_quantity(t.cons(), t.hh()))


@query("item_energy", VIEWS, f"SELECT item_code, food_group, round(energy_kcal, 6) AS energy_kcal FROM {ENERGY}")
def item_energy(t):
    items = food_groups.item_energy(food_groups.item_quantity(t.cons(), t.hh()), t.fct())
    return rounded(items.select("item_code", "food_group", "energy_kcal"), 6)


@query("food_group_regroup", VIEWS, f"SELECT item_code, food_group, food_group_new FROM {ENERGY}")
def food_group_regroup(t):
    return _energy(t).select("item_code", "food_group", "food_group_new")


@query("group_energy", VIEWS, f"SELECT food_group_new, round(totalenergy_kcal, 2) AS totalenergy_kcal FROM {GROUPED}")
def group_energy(t):
    return rounded(food_groups.group_energy(_energy(t)), 2)


def s_share(parts):
    return f"""
    SELECT food_group_new, round(totalenergy_kcal, 2) AS totalenergy_kcal, round(energypct, 6) AS energypct,
           CAST(row_number() OVER (ORDER BY energypct DESC, food_group_new) AS INTEGER) AS rank,
           CAST(CAST(round_even(energypct, 0) AS BIGINT) AS VARCHAR) || '%' AS label
    FROM (SELECT p.food_group_new, p.totalenergy_kcal, 100 * p.totalenergy_kcal / o.overall AS energypct
          FROM ({parts}) p, (SELECT sum(totalenergy_kcal) AS overall FROM {GROUPED}) o)"""


S_MAIN = s_share(f"""
    SELECT CASE WHEN {IN_NUTRITIOUS} THEN 'Nutritious foods' ELSE food_group_new END AS food_group_new,
           sum(totalenergy_kcal) AS totalenergy_kcal FROM {GROUPED} GROUP BY 1 HAVING sum(totalenergy_kcal) > 0""")
S_NUTRITIOUS = s_share(f"SELECT * FROM {GROUPED} WHERE {IN_NUTRITIOUS}")


@query("energy_report", VIEWS, f"SELECT *, 'main' AS part FROM ({S_MAIN}) UNION ALL SELECT *, 'nutritious' FROM ({S_NUTRITIOUS})")
def energy_report_(t):
    done = energy_report(t.cons(), t.hh(), t.fct(), t.food_group_map())
    return rounded(rounded(done, 2, "totalenergy_kcal"), 6, "energypct")


@query("energy_share_main", VIEWS, S_MAIN)
def energy_share_main(t):
    shares = food_groups.energy_share(food_groups.group_energy(_energy(t)))
    return rounded(rounded(shares, 2, "totalenergy_kcal"), 6, "energypct")


@query("energy_share_nutritious", VIEWS, S_NUTRITIOUS)
def energy_share_nutritious(t):
    shares = food_groups.energy_share(food_groups.group_energy(_energy(t)), breakdown=True)
    return rounded(rounded(shares, 2, "totalenergy_kcal"), 6, "energypct")


# --- contributions ----------------------------------------------------------------

def _flags(t, nutrients):
    return below_requirement(apparent_intake(t.survey(), nutrients), nutrients).select(
        "hhid", *[f"{n}_inadequate" for n in nutrients])


def s_contributions(nutrients, groups=contribution.GROUPS):
    """Item shares straight from the definition, one block per nutrient and group."""
    blocks = []
    for n in nutrients:
        for g in groups:
            keep = {"total": "true", "risk": f"i.{n} < {params.REQUIREMENT[n]}",
                    "not_risk": f"NOT (i.{n} < {params.REQUIREMENT[n]})"}[g]
            blocks.append(f"""
            SELECT '{n}' AS nutrient, '{g}' AS grp, item_code, item_name, intake / sum(intake) OVER () * 100 AS contribution_pct
            FROM (SELECT c.item_code, f.item_name,
                         coalesce(sum(f.{n} * CASE WHEN h.afe > 0 THEN c.quantity_100g / h.afe END), 0e0) AS intake
                  FROM cons c LEFT JOIN hh h ON c.hhid IS NOT DISTINCT FROM h.hhid
                  LEFT JOIN fct f ON c.item_code IS NOT DISTINCT FROM f.item_code
                  LEFT JOIN intake i ON c.hhid IS NOT DISTINCT FROM i.hhid WHERE {keep} GROUP BY 1, 2) WHERE intake > 0""")
    return f"({' UNION ALL '.join(blocks)})"


def _contribution(group):
    @query(f"contrib_{group}", "hh cons fct intake", f"""
        SELECT item_code, item_name, round(contribution_pct, 6) AS contribution_pct FROM {s_contributions([ZINC], [group])}""")
    def run(t):
        flags = None if group == "total" else _flags(t, [ZINC])
        return rounded(contribution.food_contribution(t.survey(), flags, ZINC, group))
    return run


contrib_total, contrib_risk, contrib_not_risk = (_contribution(g) for g in contribution.GROUPS)


@query("contrib_all", "hh cons fct intake", f"""
    SELECT nutrient, grp, item_code, item_name, round(contribution_pct, 6) AS contribution_pct
    FROM {s_contributions(CORE)}""")
def contrib_all(t):
    return rounded(contribution.food_contributions_all(t.survey(), _flags(t, CORE), CORE))


DELTA = f"""(SELECT *, contribution_pct_not_risk - contribution_pct_risk AS contribution_pct_delta FROM (
    SELECT coalesce(a.nutrient, b.nutrient, d.nutrient) AS nutrient, coalesce(a.item_code, b.item_code, d.item_code) AS item_code,
           coalesce(a.item_name, b.item_name, d.item_name) AS item_name, coalesce(a.contribution_pct, 0e0) AS contribution_pct_all,
           coalesce(b.contribution_pct, 0e0) AS contribution_pct_risk, coalesce(d.contribution_pct, 0e0) AS contribution_pct_not_risk
    FROM (SELECT * FROM shares WHERE grp = 'total') a
    FULL JOIN (SELECT * FROM shares WHERE grp = 'risk') b ON a.nutrient = b.nutrient AND a.item_code = b.item_code
         AND a.item_name IS NOT DISTINCT FROM b.item_name
    FULL JOIN (SELECT * FROM shares WHERE grp = 'not_risk') d ON coalesce(a.nutrient, b.nutrient) = d.nutrient
         AND coalesce(a.item_code, b.item_code) = d.item_code
         AND coalesce(a.item_name, b.item_name) IS NOT DISTINCT FROM d.item_name))"""


def _table(t):
    return contribution.contribution_table(contribution.food_contributions_all(t.survey(), _flags(t, CORE), CORE))


@query("contrib_delta", "hh cons fct intake", f"""
    WITH shares AS (SELECT * FROM {s_contributions(CORE)})
    SELECT nutrient, item_code, item_name, round(contribution_pct_all, 6) AS contribution_pct_all,
           round(contribution_pct_risk, 6) AS contribution_pct_risk,
           round(contribution_pct_not_risk, 6) AS contribution_pct_not_risk,
           round(contribution_pct_delta, 6) AS contribution_pct_delta FROM {DELTA}""")
def contrib_delta(t):
    return rounded(_table(t))


@query("contrib_top5", "hh cons fct intake", f"""
    WITH shares AS (SELECT * FROM {s_contributions(CORE)})
    SELECT nutrient, rank, item_name, round_even(contribution_pct_not_risk, 1) AS contribution_pct_not_risk,
           round_even(contribution_pct_risk, 1) AS contribution_pct_risk,
           round_even(contribution_pct_delta, 1) AS contribution_pct_delta
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY nutrient ORDER BY contribution_pct_delta DESC, item_code, item_name)
                         AS INTEGER) AS rank FROM {DELTA}) WHERE rank <= 5""")
def contrib_top5(t):
    return contribution.top_delta(_table(t))


def s_top20(nutrients, columns):
    return f"""
    WITH shares AS (SELECT *, CAST(row_number() OVER (PARTITION BY nutrient ORDER BY contribution_pct DESC, item_code, item_name)
                         AS INTEGER) AS rank FROM {s_contributions(nutrients, ["total"])})
    SELECT {columns}, round_even(contribution_pct, 0) AS contribution_pct,
           item_name || chr(10) || CAST(CAST(round_even(contribution_pct, 0) AS BIGINT) AS VARCHAR) || '%' AS label
    FROM (SELECT nutrient, rank, item_name, contribution_pct FROM shares WHERE rank <= 20 UNION ALL
          SELECT nutrient, 21, 'Others', coalesce(sum(CASE WHEN rank > 20 THEN contribution_pct END), 0e0)
          FROM shares GROUP BY nutrient)"""


@query("top20_others", "hh cons fct intake", s_top20([ZINC], "nutrient, rank, item_name"))
def top20_others(t):
    return contribution.top_n_others(contribution.food_contributions_all(t.survey(), None, [ZINC], ["total"]))


@query("top20_report", "hh cons fct intake", s_top20(CORE, "nutrient, rank, item_name"))
def top20_report(t):
    """Written with one folder per nutrient, then read back."""
    shares = contribution.food_contributions_all(t.survey(), None, CORE, ["total"])
    target = write_report(contribution.top_n_others(shares), stage_path(t.spark, "top20"))
    return t.spark.read.parquet(target).select(
        "nutrient", F.col("rank"), "item_name", "contribution_pct", "label")
