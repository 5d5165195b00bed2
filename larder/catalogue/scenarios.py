"""Fortification scenarios."""

from __future__ import annotations

from larder import params
from larder.catalogue import query, r, rounded
from larder.catalogue.intakes import CORE, CUT, W, s_iron, s_mar_by_region, s_prevalence
from larder.operators import indicators
from larder.operators.scenario import fortification_scenario, fortify, fortify_all

FLOUR = ["vitb12_mcg", "fe_mg", "zn_mg", "folate_mcg"]


def s_replace(n, level, losses):
    """Wheat after maize: the later vehicle holds."""
    wheat = f"{params.WHEAT_LEVELS[n]}e0 * w.fraction * (1 - {losses[n]}e0)"
    maize = f"{level[n]}e0 * m.fraction * (1 - {losses[n]}e0)"
    return f"CASE WHEN w.fraction IS NOT NULL THEN {wheat} WHEN m.fraction IS NOT NULL THEN {maize} ELSE f.{n} END AS {n}"


FORTIFIED = ("SELECT f.item_code, " + ", ".join(s_replace(n, params.MAIZE_LEVELS, params.FLOUR_LOSSES) for n in FLOUR)
             + ", CASE WHEN o.fraction IS NOT NULL THEN 1700e0 * o.fraction * (1 - 0.32e0) ELSE f.vita_rae_mcg END AS vita_rae_mcg"
             " FROM fct f LEFT JOIN vehicle_maize m ON f.item_code = m.item_code"
             " LEFT JOIN vehicle_wheat w ON f.item_code = w.item_code LEFT JOIN vehicle_oil o ON f.item_code = o.item_code")
FORTIFY_VIEWS = "fct vehicle_maize vehicle_wheat vehicle_oil"
SCENARIO = ("(SELECT s.hhid, h.adm1, h.survey_wgt, " + ", ".join(f"s.{n} / nullif(h.afe, 0) AS {n}" for n in CORE)
            + " FROM (SELECT c.hhid, " + ", ".join(f"coalesce(sum(x.{n} * c.quantity_100g), 0e0) AS {n}" for n in CORE)
            + f" FROM cons c LEFT JOIN ({FORTIFIED}) x ON c.item_code = x.item_code GROUP BY c.hhid) s"
            " LEFT JOIN hh h ON s.hhid = h.hhid)")
SCENARIO_VIEWS = "hh cons " + FORTIFY_VIEWS


@query("fortify_fct", FORTIFY_VIEWS, f"SELECT item_code, {r(CORE)} FROM ({FORTIFIED})")
def fortify_fct(t):
    return rounded(fortify_all(t.fct(), t.vehicles()).select("item_code", *CORE))


@query("fortify_oil", "fct vehicle_oil", """
    SELECT f.item_code, round(CASE WHEN o.fraction IS NOT NULL THEN 1700e0 * o.fraction * (1 - 0.32e0)
                                   ELSE f.vita_rae_mcg END, 6) AS vita_rae_mcg
    FROM fct f LEFT JOIN vehicle_oil o ON f.item_code = o.item_code""")
def fortify_oil(t):
    return rounded(fortify(t.fct(), t.vehicles()[2]).select("item_code", "vita_rae_mcg"))


def _scenario(t, nutrients, *keep):
    return fortification_scenario(t.survey(), nutrients, t.vehicles(), keep)


# All nutrients a vehicle carries must be there, so the composition keeps them all and
# column pruning drops those a scenario does not use.
@query("scenario_intake", SCENARIO_VIEWS, f"SELECT hhid, {r(CORE, 5)} FROM {SCENARIO}")
def scenario_intake(t):
    return rounded(_scenario(t, CORE), 5)


@query("scenario_prevalence", SCENARIO_VIEWS, s_prevalence(CUT, 0, SCENARIO, "adm1"))
def scenario_prevalence(t):
    return indicators.prevalence(_scenario(t, CUT, W, "adm1"), W, by=["adm1"], digits=0)


@query("scenario_fe_prevalence", SCENARIO_VIEWS, f"""
    SELECT adm1, round_even(avg({s_iron("fe_mg")}) * 100, 0) AS fe_inadequacy FROM {SCENARIO} GROUP BY adm1""")
def scenario_fe_prevalence(t):
    return indicators.fe_prevalence(_scenario(t, ["fe_mg"], "adm1"), None, ["adm1"], digits=0)


@query("scenario_mar", SCENARIO_VIEWS, s_mar_by_region(CORE, SCENARIO))
def scenario_mar(t):
    return indicators.mar_prevalence(_scenario(t, CORE, W, "adm1"), W, by=["adm1"])
