"""Properties that hold for any data, on the test tables and on random input."""

import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder import params
from larder.functions.nutrition import below_requirement, with_adequacy_ratios, with_mar, with_mpa
from larder.operators import food_groups, indicators, ordering
from larder.operators.intake import apparent_intake
from larder.operators.scenario import fortification_scenario
from larder.operators.survey import SurveyDesign
from larder.sources.adapters import Tables
from larder.sources.staging import stage

CORE = params.CORE_NUTRIENTS
FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return Tables(spark, sf_dir)


@pytest.fixture(scope="module")
def intake(tables):
    return stage(apparent_intake(tables.survey(), CORE, ["survey_wgt", "adm1", "res"]))


def test_scores_lie_between_zero_and_one(intake):
    scored = with_mpa(with_mar(with_adequacy_ratios(below_requirement(intake, CORE), CORE), CORE))
    scores = [c for c in scored.columns if c.endswith(("_inadequate", "_nar")) or c.startswith("pa_") or c in ("mar", "mpa", "mpi", "flag")]
    assert len(scores) == 5 + 5 + 5 + 2 + 3
    outside = [F.count_if((F.col(c) < 0) | (F.col(c) > 1)).alias(c) for c in scores]
    assert sum(scored.agg(*outside).first()) == 0


def test_gradient_overall_equals_mean_by_quintile(intake):
    ranked = ordering.ntile_exact(with_mpa(intake), "survey_wgt", 5, ["hhid"], "q")
    design = SurveyDesign(ranked, "survey_wgt")
    sets = design.mean_sets(["mpi"], [["q"], ["q", "res"]], {"res": "Overall"}).filter("res = 'Overall'")
    assert {r.q: r.mpi for r in sets.collect()} == pytest.approx({r.q: r.mpi for r in design.mean(["mpi"], ["q"]).collect()})
    assert [r["count"] for r in ranked.groupBy("q").count().orderBy("q").collect()] == [30] * 5


def test_report_agrees_with_single_indicators(intake):
    from larder.plans.reports import region_report

    report = {r.adm1: r for r in region_report(intake, "survey_wgt").collect()}
    for r in indicators.prevalence(intake, "survey_wgt", by=["adm1"], digits=0).collect():
        assert report[r.adm1].zn_inadequacy == r.zn_inadequacy
    for r in indicators.mar_prevalence(intake, "survey_wgt", by=["adm1"]).collect():
        assert report[r.adm1].mar == r.mar


def test_scenario_changes_only_carried_nutrients(tables):
    base = apparent_intake(tables.survey(), ["ca_mg", "zn_mg"])
    fortified = fortification_scenario(tables.survey(), CORE + ["ca_mg"], tables.vehicles()).select("hhid", "ca_mg", F.col("zn_mg").alias("zn2"))
    both = base.join(fortified.withColumnRenamed("ca_mg", "ca2"), "hhid")
    row = both.agg(F.max(F.abs(F.col("ca_mg") - F.col("ca2"))).alias("ca"), F.max(F.abs(F.col("zn_mg") - F.col("zn2"))).alias("zn")).first()
    assert row.ca < 1e-9 < row.zn


def test_energy_shares_sum_to_hundred(tables):
    items = food_groups.item_energy(food_groups.item_quantity(tables.cons(), tables.hh()), tables.fct())
    energy = food_groups.group_energy(food_groups.regroup(items, tables.food_group_map()))
    assert food_groups.energy_share(energy).agg(F.sum("energypct")).first()[0] == pytest.approx(100)
    nutritious = food_groups.energy_share(energy).filter("food_group_new = 'Nutritious foods'").first().energypct
    assert food_groups.energy_share(energy, breakdown=True).agg(F.sum("energypct")).first()[0] == pytest.approx(nutritious)


values = st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-1e6, 1e6))


@FEW
@given(st.lists(st.tuples(st.sampled_from("aab"), values), min_size=1, max_size=60))
def test_ranking_against_python(spark, data):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)], "id int, g string, v double")
    known = {g: sorted((v, i) for i, (h, v) in enumerate(data) if h == g and v is not None) for g in "ab"}
    medians = {r.g: r.m for r in ordering.quantiles_exact(df, "v", [0.5], ["id"], ["g"], ["m"]).collect()}
    assert medians == pytest.approx({g: statistics.median(v for v, _ in rows) for g, rows in known.items() if rows})
    groups = {r.id: r.q for r in ordering.ntile_exact(df, "v", 5, ["id"], "q", ["g"]).collect()}
    for rows in known.values():
        small, larger = divmod(len(rows), 5)
        expected = [q for q in range(1, 6) for _ in range(small + (q <= larger))]
        assert [groups[i] for _, i in rows] == expected
    assert all(groups[i] is None for i, (_, v) in enumerate(data) if v is None)


@FEW
@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(0.1, 100)), st.one_of(st.none(), st.floats(0, 1))), min_size=2, max_size=40))
def test_error_against_python(spark, data):
    df = spark.createDataFrame(data, "w double, x double")
    design = [(w, x) for w, x in data if w is not None]
    used = [(w, x) for w, x in design if x is not None]
    if any(w is None and x is not None for w, x in data):
        with pytest.raises(Exception, match="rows without a weight in w"):
            SurveyDesign(df, "w").mean_ci("x").collect()
    got = SurveyDesign(df, "w", on_null="drop").mean_ci("x").first()
    if not used or len(design) < 2:
        assert not used and (got is None or got.x is None) or got.x_se in (None, 0.0)
        return
    total = sum(w for w, _ in used)
    mean = sum(w * x for w, x in used) / total
    n = len(design)
    se = math.sqrt(n / (n - 1) * sum((w * (x - mean) / total) ** 2 for w, x in used))
    assert got.x == pytest.approx(mean)
    assert got.x_se == pytest.approx(se, rel=1e-5, abs=1e-7)
