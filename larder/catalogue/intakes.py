"""Intake, inadequacy, survey estimates and probability of adequacy."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from larder import params
from larder.catalogue import query, r, rounded
from larder.functions.nutrition import (
    below_requirement,
    iron_inadequacy,
    with_adequacy_probabilities,
    with_adequacy_ratios,
    with_mar,
    with_mpa,
)
from larder.functions.stats import PHI_DENOMINATOR, PHI_LIMIT, PHI_NUMERATOR, PHI_SPLIT, ROOT_TWO_PI, Z_975
from larder.operators import checks, indicators, regions
from larder.operators.intake import apparent_intake, base_model
from larder.operators.ordering import ntile_exact
from larder.operators.survey import LONELY, SurveyDesign, gap, interaction, long, quintile_label
from larder.plans.reports import mpi_report, national_report, region_report
from larder.sources.adapters import DROP_REGIONS, ISO3, RESPELL, SURVEY
from larder.sources.staging import stage
from larder.sources.tables import Survey

ALL, CORE, CUT = params.NUTRIENTS, params.CORE_NUTRIENTS, params.CUT_POINT_NUTRIENTS
EAR = params.REQUIREMENT
W = "survey_wgt"


def _intake(t, nutrients, *keep):
    return apparent_intake(t.survey(), nutrients, keep)


def _with_quintiles(t, *columns):
    """Intakes of households ranked by expenditure."""
    hh = t.hh()
    if "sep_quintile" in columns:
        hh = ntile_exact(hh, "pc_expenditure", 5, ["hhid"], "sep_quintile")
    if "res_quintile" in columns:
        hh = ntile_exact(hh, "pc_expenditure", 5, ["hhid"], "res_quintile", by=["res"])
    # Written, as the household table is once it has its quintiles: its size is then known.
    return Survey(stage(hh), t.cons(), t.fct())


# --- SQL pieces -------------------------------------------------------------------

def s_flag(n, prefix=""):
    return f"CAST({prefix}{n} < {EAR[n]} AS INTEGER)"


def s_wmean(x, w=W):
    return f"sum({w} * ({x})) / nullif(sum(CASE WHEN ({x}) IS NOT NULL THEN {w} END), 0)"


def s_iron(x, bio=10):
    bands = " ".join(f"WHEN {x} <= {e} THEN CAST({p} AS DOUBLE)"
                     for e, p in zip(params.IRON_EDGES[bio], params.IRON_PROBABILITY, strict=False))
    return f"CASE {bands} WHEN {x} > {params.IRON_EDGES[bio][-1]} THEN 0e0 END"


def s_nar(n):
    return f"CASE WHEN {n} / {EAR[n]} > 1 THEN 1e0 ELSE {n} / {EAR[n]} END"


def s_row_mean(xs):
    total = " + ".join(f"coalesce({x}, 0)" for x in xs)
    count = " + ".join(f"CAST(({x}) IS NOT NULL AS INTEGER)" for x in xs)
    return f"({total}) / nullif({count}, 0)"


def s_mar(nutrients):
    return s_row_mean([s_nar(n) for n in nutrients])


def _s_horner(coefficients, z):
    text = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        text = f"({text} * {z} + CAST({c!r} AS DOUBLE))"
    return text


def s_phi(x):
    z = f"abs({x})"
    far = f"({z} + 0.65e0)"
    for k in (4, 3, 2, 1):
        far = f"({z} + {k} / {far})"
    tail = (f"CASE WHEN {z} > {PHI_LIMIT} THEN 0e0 WHEN {z} < CAST({PHI_SPLIT!r} AS DOUBLE) "
            f"THEN exp(-{z} * {z} / 2) * {_s_horner(PHI_NUMERATOR, z)} / {_s_horner(PHI_DENOMINATOR, z)} "
            f"ELSE exp(-{z} * {z} / 2) / {far} / CAST({ROOT_TWO_PI!r} AS DOUBLE) END")
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END"


PA_SQL = {f"pa_{n}": s_phi(f"(({n} - {EAR[n]}) / CAST({EAR[n] * cv!r} AS DOUBLE))")
          for n, cv in params.VARIATION.items()} | {"pa_fe_mg": f"1 - ({s_iron('fe_mg')})"}
SCORES_SQL = ("SELECT *, mpa_ AS mpa, CAST(mpa_ < 0.5 AS INTEGER) AS flag, 1 - mpa_ AS mpi FROM (SELECT *, "
              + s_row_mean(list(PA_SQL)) + " AS mpa_ FROM (SELECT *, "
              + ", ".join(f"{e} AS {n}" for n, e in PA_SQL.items()) + " FROM described))")


def s_t975(v):
    z = Z_975
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96,
             (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
             (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return f"({z!r}e0 " + " ".join(f"+ {c!r}e0 / ({v} ** {i + 1})" for i, c in enumerate(terms)) + ")"


def s_mean_ci(source, x, by, digits):
    """Two passes: means per group, then squared residuals."""
    keys = f"{by}, " if by else ""
    on = f"d.{by} IS NOT DISTINCT FROM m.{by}" if by else "true"
    group = f"GROUP BY {by}" if by else ""
    group2 = f"GROUP BY m.{by}" if by else ""
    head = f"m.{by}, " if by else ""
    return f"""
    WITH d AS ({source}),
    m AS (SELECT {keys}{s_wmean(x)} AS m, sum(CASE WHEN {x} IS NOT NULL THEN {W} END) AS sw FROM d {group}),
    n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d WHERE {W} IS NOT NULL),
    e AS (SELECT {head}any_value(m.m) AS m, any_value(n.n) AS n,
                 sqrt(any_value(n.n) / (any_value(n.n) - 1) * sum(({W} * (d.{x} - m.m) / m.sw) ** 2)) AS se
          FROM d JOIN m ON {on} CROSS JOIN n {group2})
    SELECT {keys}round_even(m, {digits}) AS {x}, round(se, 8) AS {x}_se,
           round(m - {s_t975("(n - 1)")} * se, 8) AS {x}_low, round(m + {s_t975("(n - 1)")} * se, 8) AS {x}_upp FROM e"""


# --- intake -----------------------------------------------------------------------

@query("apparent_intake", "intake", f"SELECT hhid, {r(ALL, 5)} FROM intake")
def q_apparent_intake(t):
    return rounded(_intake(t, ALL), 5)


@query("base_model", "intake", f"SELECT '{ISO3}' AS iso3, '{SURVEY}' AS survey, hhid, {r(ALL, 5)} FROM intake")
def q_base_model(t):
    return rounded(base_model(_intake(t, ALL), ISO3, SURVEY), 5)


@query("summary_energy", "intake", """
    SELECT round(min(energy_kcal), 4) AS min, round(quantile_cont(energy_kcal, 0.25), 4) AS q1,
           round(median(energy_kcal), 4) AS median, round(avg(energy_kcal), 4) AS mean,
           round(quantile_cont(energy_kcal, 0.75), 4) AS q3, round(max(energy_kcal), 4) AS max,
           count(*) - count(energy_kcal) AS n_missing FROM intake""")
def summary_energy(t):
    return rounded(checks.summary_stats(_intake(t, ["energy_kcal"]), "energy_kcal", ["hhid"]), 4)


@query("histogram_energy", "intake", """
    SELECT CAST(floor(energy_kcal / (10000e0 / 30)) + 1 AS BIGINT) AS bin, count(*) AS n,
           round(floor(energy_kcal / (10000e0 / 30)) * (10000e0 / 30), 4) AS bin_start,
           (SELECT round(median(energy_kcal), 4) FROM intake) AS median
    FROM intake WHERE energy_kcal >= 0 AND energy_kcal < 10000 GROUP BY 1, 3""")
def histogram_energy(t):
    return rounded(checks.histogram(_intake(t, ["energy_kcal"]), "energy_kcal", tie=["hhid"]), 4, "bin_start", "median")


# --- inadequacy -------------------------------------------------------------------

@query("inadequacy_flags", "intake", "SELECT hhid, "
       + ", ".join(f"{s_flag(n)} AS {n}_inadequate" for n in CORE) + " FROM intake")
def inadequacy_flags(t):
    return below_requirement(_intake(t, CORE), CORE).select("hhid", *[f"{n}_inadequate" for n in CORE])


@query("design_check", "hh", """
    SELECT count(*) AS n_rows, CAST(count(*) FILTER (WHERE survey_wgt IS NULL) AS BIGINT) AS null_weights,
           CAST(count(*) FILTER (WHERE survey_wgt <= 0) AS BIGINT) AS non_positive_weights,
           CAST(count(*) FILTER (WHERE (adm1 || '.' || res) IS NULL) AS BIGINT) AS null_strata,
           round(sum(survey_wgt), 2) AS sum_weights FROM hh""")
def design_check(t):
    hh = t.hh().withColumn("stratum", interaction("adm1", "res"))
    return rounded(SurveyDesign(hh, W, "stratum").check(), 2, "sum_weights")


@query("strata_sizes", "hh", """
    SELECT adm1 || '.' || res AS stratum, count(*) AS n, round(sum(survey_wgt), 2) AS sum_weights FROM hh GROUP BY 1""")
def strata_sizes(t):
    hh = t.hh().withColumn("stratum", interaction("adm1", "res"))
    return rounded(hh.groupBy("stratum").agg(F.count("*").alias("n"), F.sum(W).alias("sum_weights")), 2)


def s_prevalence(nutrients, digits, source="described", by=""):
    keys = f"{by}, " if by else ""
    return f"SELECT {keys}" + ", ".join(
        f"round_even({s_wmean(s_flag(n))} * 100, {digits}) AS {indicators.short_name(n)}" for n in nutrients
    ) + f" FROM {source}" + (f" GROUP BY {by}" if by else "")


@query("prevalence_national", "described", s_prevalence(CUT, 1))
def prevalence_national(t):
    return indicators.prevalence(_intake(t, CUT, W), W, digits=1)


@query("prevalence_by_region", "described", s_prevalence(CUT, 0, by="adm1"))
def prevalence_by_region(t):
    return indicators.prevalence(_intake(t, CUT, W, "adm1"), W, by=["adm1"], digits=0)


def _fe_rows(bio):
    @query(f"fe_prob_rows_{bio}", "intake",
           f"SELECT hhid, round(fe_mg, 6) AS fe_mg, {s_iron('fe_mg', bio)} AS prob_inad FROM intake")
    def run(t):
        return rounded(_intake(t, ["fe_mg"]).withColumn("prob_inad", iron_inadequacy(F.col("fe_mg"), bio)))
    return run


fe_prob_rows_5, fe_prob_rows_10, fe_prob_rows_15 = _fe_rows(5), _fe_rows(10), _fe_rows(15)


@query("fe_prevalence_national", "described",
       f"SELECT round({s_wmean(s_iron('fe_mg'))} * 100, 6) AS fe_inadequacy FROM described")
def fe_prevalence_national(t):
    return rounded(indicators.fe_prevalence(_intake(t, ["fe_mg"], W), W))


@query("fe_prevalence_strict", "described", f"""
    SELECT adm1, CASE WHEN count(*) = count(fe_mg) THEN round({s_wmean(s_iron('fe_mg'))} * 100, 6) END AS fe_inadequacy
    FROM (SELECT adm1, {W}, CASE WHEN adm1 = 'NATION_3' AND hhid % 2 = 0 THEN NULL ELSE fe_mg END AS fe_mg FROM described) GROUP BY adm1""")
def fe_prevalence_strict(t):
    """A region with unknown intakes (made here in one of them) has no estimate."""
    gone = (F.col("adm1") == "NATION_3") & (F.col("hhid") % 2 == 0)
    rows = _intake(t, ["fe_mg"], W, "adm1").withColumn("fe_mg", F.when(~gone, F.col("fe_mg")))
    return rounded(indicators.fe_prevalence(rows, W, ["adm1"], strict=True))


@query("fe_prevalence_region_weighted", "described",
       f"SELECT adm1, round_even({s_wmean(s_iron('fe_mg'))} * 100, 0) AS fe_inadequacy FROM described GROUP BY adm1")
def fe_prevalence_region_weighted(t):
    return indicators.fe_prevalence(_intake(t, ["fe_mg"], W, "adm1"), W, ["adm1"], digits=0)


@query("fe_prevalence_region_unweighted", "described",
       f"SELECT adm1, round_even(avg({s_iron('fe_mg')}) * 100, 0) AS fe_inadequacy FROM described GROUP BY adm1")
def fe_prevalence_region_unweighted(t):
    return indicators.fe_prevalence(_intake(t, ["fe_mg"], "adm1"), None, ["adm1"], digits=0)


@query("fe_mean_prob_region", "described",
       f"SELECT adm1, round({s_wmean(s_iron('fe_mg'))}, 6) AS fe_prob_inad FROM described GROUP BY adm1")
def fe_mean_prob_region(t):
    rows = _intake(t, ["fe_mg"], W, "adm1").withColumn("fe_prob_inad", iron_inadequacy(F.col("fe_mg"), 10))
    return rounded(SurveyDesign(rows, W).mean(["fe_prob_inad"], ["adm1"]))


@query("nar_rows", "intake", "SELECT hhid, "
       + ", ".join(f"round({s_nar(n)}, 6) AS {n}_nar" for n in CORE) + " FROM intake")
def nar_rows(t):
    return rounded(with_adequacy_ratios(_intake(t, CORE), CORE).select("hhid", *[f"{n}_nar" for n in CORE]))


@query("mar_rows", "intake", f"""
    SELECT hhid, round(mar, 6) AS mar, CAST(mar < 0.75 AS INTEGER) AS mar_inadequate
    FROM (SELECT hhid, {s_mar(CORE)} AS mar FROM intake)""")
def mar_rows(t):
    return rounded(with_mar(_intake(t, CORE), CORE).select("hhid", "mar", "mar_inadequate"))


def s_mar_by_region(nutrients, source="described"):
    flag = f"CAST({s_mar(nutrients)} < 0.75 AS INTEGER)"
    return f"SELECT adm1, round_even({s_wmean(flag)} * 100, 1) AS mar FROM {source} GROUP BY adm1"


@query("mar_by_region", "described", s_mar_by_region(CORE))
def mar_by_region(t):
    return indicators.mar_prevalence(_intake(t, CORE, W, "adm1"), W, by=["adm1"])


@query("mar4_by_region", "described", s_mar_by_region(params.MAR4_NUTRIENTS))
def mar4_by_region(t):
    nutrients = params.MAR4_NUTRIENTS
    return indicators.mar_prevalence(_intake(t, nutrients, W, "adm1"), W, nutrients, ["adm1"])


@query("region_report", "described", "SELECT adm1, "
       + ", ".join(f"round_even({s_wmean(s_flag(n))} * 100, 0) AS {indicators.short_name(n)}" for n in CUT)
       + f", round_even(avg({s_iron('fe_mg')}) * 100, 0) AS fe_inadequacy, "
       + f"round_even({s_wmean(f'CAST({s_mar(CORE)} < 0.75 AS INTEGER)')} * 100, 1) AS mar FROM described GROUP BY adm1")
def q_region_report(t):
    return region_report(_intake(t, CORE, W, "adm1"), W)


@query("national_report", "described", "SELECT "
       + ", ".join(f"round_even({s_wmean(s_flag(n))} * 100, 1) AS {indicators.short_name(n)}" for n in CUT)
       + f", round_even({s_wmean(s_iron('fe_mg'))} * 100, 1) AS fe_inadequacy, "
       + f"round_even({s_wmean(f'CAST({s_mar(CORE)} < 0.75 AS INTEGER)')} * 100, 1) AS mar FROM described")
def q_national_report(t):
    return national_report(_intake(t, CORE, W), W)


# --- regions ----------------------------------------------------------------------

@query("conform_regions", "hh", """
    SELECT CASE adm1 WHEN 'NATION_7' THEN 'NATION_07' ELSE adm1 END AS adm1, count(*) AS n_households
    FROM hh WHERE NOT regexp_matches(adm1, 'NATION_2[34]') GROUP BY adm1""")
def conform_regions(t):
    """Names of the regions households live in, conformed."""
    named = t.hh().groupBy("adm1").agg(F.count("*").alias("n_households"))
    return regions.conform_regions(named, DROP_REGIONS, RESPELL)


@query("region_estimates", "described regions", f"""
    SELECT r.adm1, {", ".join(f"e.{indicators.short_name(n)}" for n in CUT)}
    FROM regions r LEFT JOIN ({s_prevalence(CUT, 0, by="adm1")}) e ON r.adm1 IS NOT DISTINCT FROM e.adm1""")
def region_estimates(t):
    """Every conformed region with its estimates, missing where the spelling differs."""
    estimates = indicators.prevalence(_intake(t, CUT, W, "adm1"), W, by=["adm1"], digits=0)
    return regions.join_regions(estimates, regions.conform_regions(t.region_dim(), DROP_REGIONS, RESPELL), "regions")


@query("region_labels", "described regions", f"""
    SELECT r.adm1, e.vita_inadequacy, r.adm1 || chr(10) || CAST(CAST(e.vita_inadequacy AS BIGINT) AS VARCHAR) || '%' AS label
    FROM regions r JOIN ({s_prevalence(["vita_rae_mcg"], 0, by="adm1")}) e ON r.adm1 = e.adm1
    WHERE e.vita_inadequacy IS NOT NULL""")
def region_labels(t):
    estimates = indicators.prevalence(_intake(t, ["vita_rae_mcg"], W, "adm1"), W, ["vita_rae_mcg"], ["adm1"], 0)
    dim = regions.conform_regions(t.region_dim(), DROP_REGIONS, RESPELL)
    return regions.label_rows(regions.join_regions(estimates, dim, "regions"), "adm1", "vita_inadequacy")


# --- probability of adequacy ------------------------------------------------------

@query("pa_rows", "described", "SELECT hhid, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in PA_SQL.items()
                                                            if n != "pa_fe_mg") + " FROM described")
def pa_rows(t):
    return rounded(with_adequacy_probabilities(_intake(t, CORE)).select("hhid", *[f"pa_{n}" for n in params.VARIATION]))


@query("pa_iron", "intake", f"SELECT hhid, round({PA_SQL['pa_fe_mg']}, 6) AS pa_fe_mg FROM intake")
def pa_iron(t):
    return rounded(with_adequacy_probabilities(_intake(t, ["fe_mg"]), variation={}).select("hhid", "pa_fe_mg"))


@query("mpa_rows", "described", f"SELECT hhid, round(mpa, 6) AS mpa, flag FROM ({SCORES_SQL})")
def mpa_rows(t):
    return rounded(with_mpa(_intake(t, CORE)).select("hhid", "mpa", "flag"))


@query("mpi_rows", "described", f"SELECT hhid, round(mpi, 6) AS mpi FROM ({SCORES_SQL})")
def mpi_rows(t):
    return rounded(with_mpa(_intake(t, CORE)).select("hhid", "mpi"))


MPI_SOURCE = (f"SELECT s.*, q.sep_quintile FROM ({SCORES_SQL}) s LEFT JOIN quintiles q ON s.hhid = q.hhid"
              f" WHERE s.{W} IS NOT NULL AND s.mpi IS NOT NULL AND s.adm1 IS NOT NULL AND q.sep_quintile IS NOT NULL")


def _mpi_design(t):
    """Complete households; those without a score are left out by each estimate."""
    survey = _with_quintiles(t, "sep_quintile")
    rows = apparent_intake(survey, CORE, [W, "adm1", "res", "sep_quintile"])
    return SurveyDesign(with_mpa(rows), W).complete([W, "adm1", "sep_quintile"])


@query("mpi_national_se", "described quintiles", s_mean_ci(MPI_SOURCE, "mpi", "", 3))
def mpi_national_se(t):
    return rounded(_mpi_design(t).mean_ci("mpi", digits=3, missing_counts=False), 8, "mpi_se", "mpi_low", "mpi_upp")


@query("mpi_region_ci", "described quintiles", s_mean_ci(MPI_SOURCE, "mpi", "adm1", 3))
def mpi_region_ci(t):
    estimates = _mpi_design(t).mean_ci("mpi", ["adm1"], digits=3, missing_counts=False)
    return rounded(estimates, 8, "mpi_se", "mpi_low", "mpi_upp").orderBy(F.col("mpi").desc(), "adm1")


@query("mpi_report", "described quintiles", f"""
    SELECT 'national' AS part, CAST(NULL AS VARCHAR) AS adm1, mpi AS mean_mpi, mpi_se AS mean_mpi_se FROM ({s_mean_ci(MPI_SOURCE, "mpi", "", 3)})
    UNION ALL SELECT 'region', adm1, mpi, mpi_se FROM ({s_mean_ci(MPI_SOURCE, "mpi", "adm1", 3)})""")
def mpi_report_(t):
    households = apparent_intake(_with_quintiles(t, "sep_quintile"), CORE, [W, "adm1", "res", "sep_quintile"])
    parts = mpi_report(households, W)
    shown = ["mean_mpi", "mean_mpi_se"]
    national = parts["national"].select(F.lit("national").alias("part"), F.lit(None).cast("string").alias("adm1"), *shown)
    return rounded(national.unionByName(parts["region"].select(F.lit("region").alias("part"), "adm1", *shown)), 8, "mean_mpi_se")


@query("mpi_strata_ci", "described quintiles", f"""
    WITH d AS (SELECT *, adm1 || '.' || res AS stratum FROM ({MPI_SOURCE})),
    m AS (SELECT res, {s_wmean("mpi")} AS m, sum(CASE WHEN mpi IS NOT NULL THEN {W} END) AS sw FROM d GROUP BY res),
    z AS (SELECT m.res, d.stratum, CASE WHEN d.res = m.res THEN {W} * (d.mpi - m.m) / m.sw ELSE 0e0 END AS z, m.m, d.res = m.res AS own FROM d CROSS JOIN m),
    h AS (SELECT res, stratum, any_value(m) AS m, count(*) AS n, CASE WHEN bool_or(own)
                 THEN count(*) / nullif(count(*) - 1e0, 0) * (sum(z * z) - sum(z) * sum(z) / count(*)) ELSE 0e0 END AS part
          FROM z GROUP BY res, stratum)
    SELECT res, round_even(any_value(m), 3) AS mpi, CASE WHEN count(*) = count(part) THEN round(sqrt(sum(part)), 8) END AS mpi_se, CAST(sum(n) - count(*) AS BIGINT) AS df FROM h GROUP BY res""")
def mpi_strata_ci(t):
    """Region by residence as strata, residence as domain."""
    design = _mpi_design(t).complete(["mpi"])
    rows = stage(design.df.select(W, "mpi", "adm1", "res")).withColumn("stratum", interaction("adm1", "res"))
    strata = rows.select("stratum").distinct().agg(F.count("*").alias("strata"))
    size = rows.agg(F.count("*").alias("n")).crossJoin(strata)  # one row each
    estimates = SurveyDesign(rows, design.weight, "stratum").mean_ci("mpi", ["res"], digits=3)
    return rounded(estimates.crossJoin(F.broadcast(size)).select("res", "mpi", "mpi_se", (F.col("n") - F.col("strata")).alias("df")), 8, "mpi_se")


UNIT = "CAST(floor(hhid / 50) AS BIGINT)"  # an enumeration area: households with neighbouring numbers


def s_units(domain: str, stratum: str, unit: str = UNIT) -> str:
    """CTEs d, m, z and h: rows, means by domain, linearised totals of every unit for every domain, strata's parts."""
    return f"""
    WITH d AS (SELECT *, {domain} AS domain, {stratum} AS stratum, {unit} AS unit FROM ({MPI_SOURCE})),
    m AS (SELECT domain, {s_wmean("mpi")} AS m, sum({W}) AS sw FROM d GROUP BY domain),
    z AS (SELECT m.domain, d.stratum, d.unit, any_value(m.m) AS m, sum(CASE WHEN d.domain = m.domain THEN {W} * (d.mpi - m.m) / m.sw ELSE 0e0 END) AS z,
                 bool_or(d.domain = m.domain) AS own FROM d CROSS JOIN m GROUP BY m.domain, d.stratum, d.unit),
    h AS (SELECT domain, stratum, any_value(m) AS m, count(*) AS n, bool_or(own) AS own, sum(z * z) AS zz,
                 count(*) / nullif(count(*) - 1e0, 0) * (sum(z * z) - sum(z) * sum(z) / count(*)) AS part FROM z GROUP BY domain, stratum)"""


def _mpi_units(t, stratum):
    """The scores' design with households' enumeration areas as units."""
    rows = stage(_mpi_design(t).complete(["mpi"]).df.select("hhid", W, "mpi", "adm1", "res"))
    rows = rows.withColumns({"stratum": stratum, "unit": F.floor(F.col("hhid") / 50)})
    return SurveyDesign(rows, W, "stratum", ids="unit")


@query("mpi_cluster_ci", "described quintiles", f"""{s_units("res", "adm1")}
    SELECT domain AS res, round_even(any_value(m), 3) AS mpi, CASE WHEN count(*) = count(CASE WHEN own THEN part ELSE 0 END)
           THEN round(sqrt(sum(CASE WHEN own THEN part ELSE 0 END)), 8) END AS mpi_se, CAST(sum(n) - count(*) AS BIGINT) AS df FROM h GROUP BY domain""")
def mpi_cluster_ci(t):
    """Mean scores by residence with errors from enumeration areas within regions; both residences live in an area."""
    design = _mpi_units(t, F.col("adm1"))
    estimates = design.mean_ci("mpi", ["res"], digits=3)
    units = design.check().select((F.col("n_units")).alias("n"))
    strata = design.df.select("stratum").distinct().agg(F.count("*").alias("strata"))
    size = units.crossJoin(strata)  # one row each
    return rounded(estimates.crossJoin(F.broadcast(size)).select("res", "mpi", "mpi_se", (F.col("n") - F.col("strata")).alias("df")), 8, "mpi_se")


@query("mpi_cluster_lonely", "described quintiles", f"""{s_units("1", "adm1 || '.' || res", UNIT.replace("50", "1400"))}
    SELECT rule, round_even(any_value(m), 3) AS mpi, CAST(count(*) FILTER (n = 1) AS BIGINT) AS lonely_strata,
           CASE WHEN count(part_) = count(*) THEN round(sqrt(sum(part_)), 8) END AS mpi_se
    FROM (SELECT *, CASE WHEN n > 1 THEN part WHEN rule = 'certainty' THEN 0 WHEN rule = 'adjust' THEN zz END AS part_
          FROM h CROSS JOIN (SELECT unnest(['missing', 'certainty', 'adjust']) AS rule)) GROUP BY rule""")
def mpi_cluster_lonely(t):
    """The national error under each rule for strata that have a single area."""
    design = _mpi_units(t, interaction("adm1", "res"))
    design = replace(design, df=stage(design.df.withColumn("unit", F.floor(F.col("hhid") / 1400))))
    lonely = design.check().select("lonely_strata")
    found = None
    for rule in LONELY:
        one = design.mean_ci("mpi", digits=3, lonely=rule).crossJoin(F.broadcast(lonely)).select(F.lit(rule).alias("rule"), "mpi", "lonely_strata", "mpi_se")
        found = one if found is None else found.unionByName(one)
    return rounded(found, 8, "mpi_se")


@query("mpi_gradient", "described quintiles", f"""
    WITH d AS ({MPI_SOURCE})
    SELECT CAST(sep_quintile AS INTEGER) AS sep_quintile, res, round({s_wmean("mpi")}, 6) AS mean_mpi FROM d GROUP BY sep_quintile, res
    UNION ALL SELECT CAST(sep_quintile AS INTEGER), 'Overall', round({s_wmean("mpi")}, 6) FROM d GROUP BY sep_quintile""")
def mpi_gradient(t):
    return rounded(_mpi_design(t).mean_sets({"mpi": "mean_mpi"}, [["sep_quintile"], ["sep_quintile", "res"]],
                                            {"res": "Overall"}))


# --- long form --------------------------------------------------------------------

LONG = params.LONG_NUTRIENTS


def s_long(by="", source="described", where=""):
    keys = f"{by}, " if by else ""
    names = [indicators.short_name(n) for n in LONG]
    wide = f"SELECT {keys}" + ", ".join(
        f"{s_wmean(s_flag(n))} * 100 AS {name}" for n, name in zip(LONG, names, strict=True)
    ) + f" FROM {source}" + (f" GROUP BY {by}" if by else "")
    return (f"SELECT {keys}micronutrient, round(estimate, 6) AS estimate FROM (UNPIVOT ({wide}) "
            f"ON {', '.join(names)} INTO NAME micronutrient VALUE estimate) {where}")


@query("long_national", "described", s_long())
def long_national(t):
    return rounded(long(indicators.prevalence(_intake(t, LONG, W), W, LONG)))


@query("long_residence", "described", s_long("res"))
def long_residence(t):
    return rounded(long(indicators.prevalence(_intake(t, LONG, W, "res"), W, LONG, ["res"]), ["res"]))


@query("long_region", "described", s_long("adm1"))
def long_region(t):
    return rounded(long(indicators.prevalence(_intake(t, LONG, W, "adm1"), W, LONG, ["adm1"]), ["adm1"]))


def _res_quintile(t):
    """Residence by quintile; households without a quintile are left out of the result."""
    rows = apparent_intake(_with_quintiles(t, "res_quintile"), LONG, [W, "res", "res_quintile"])
    by = ["res", "res_quintile"]
    return long(indicators.prevalence(rows, W, LONG, by), by).filter(F.col("res_quintile").isNotNull())


RES_QUINTILE = ("(SELECT d.*, CAST(q.res_quintile AS INTEGER) AS res_quintile FROM described d "
                "LEFT JOIN quintiles q ON d.hhid = q.hhid)")


@query("long_res_quintile", "described quintiles", s_long("res, res_quintile", RES_QUINTILE, "WHERE res_quintile IS NOT NULL"))
def long_res_quintile(t):
    return rounded(_res_quintile(t))


@query("urban_rural_gap", "described quintiles", f"""
    SELECT CASE res_quintile WHEN 1 THEN '1 - Poorest' WHEN 5 THEN '5 - Wealthiest'
                ELSE CAST(res_quintile AS VARCHAR) END AS res_quintile,
           max(CASE WHEN res = 'Rural' THEN estimate END) AS Rural, max(CASE WHEN res = 'Urban' THEN estimate END) AS Urban,
           round(abs(max(CASE WHEN res = 'Urban' THEN raw END) - max(CASE WHEN res = 'Rural' THEN raw END)), 6) AS diff
    FROM (SELECT res, res_quintile, round(raw, 6) AS estimate, raw
          FROM (SELECT res, res_quintile, {s_wmean(s_flag("vitb12_mcg"))} * 100 AS raw FROM {RES_QUINTILE}
                WHERE res_quintile IS NOT NULL GROUP BY res, res_quintile)) GROUP BY 1""")
def urban_rural_gap(t):
    rows = apparent_intake(_with_quintiles(t, "res_quintile"), ["vitb12_mcg"], [W, "res", "res_quintile"])
    by = ["res", "res_quintile"]
    estimates = long(indicators.prevalence(rows, W, ["vitb12_mcg"], by), by).filter(F.col("res_quintile").isNotNull())
    estimates = estimates.filter(F.col("micronutrient") == "vitb12_inadequacy")
    labelled = estimates.withColumn("res_quintile", quintile_label(F.col("res_quintile")))
    return rounded(gap(labelled, "res_quintile", "res", "Rural", "Urban"))


@query("prevalence6_by_region", "described", "SELECT adm1, "
       + ", ".join(f"round_even({s_wmean(s_flag(n))} * 100, 1) AS {indicators.short_name(n)}"
                   for n in ["vita_rae_mcg", "thia_mg", "ribo_mg", "vitb12_mcg", "zn_mg"])
       + f", round_even({s_wmean(s_iron('fe_mg'))} * 100, 1) AS fe_inadequacy FROM described GROUP BY adm1")
def prevalence6_by_region(t):
    """Five nutrients by cut-point and iron by probability, in one aggregate."""
    cut = ["vita_rae_mcg", "thia_mg", "ribo_mg", "vitb12_mcg", "zn_mg"]
    rows = below_requirement(_intake(t, [*cut, "fe_mg"], W, "adm1"), cut)
    rows = rows.withColumn("fe_prob_inad", iron_inadequacy(F.col("fe_mg"), 10))
    names = {f"{n}_inadequate": indicators.short_name(n) for n in cut} | {"fe_prob_inad": "fe_inadequacy"}
    return SurveyDesign(rows, W).mean(names, ["adm1"], 1, as_percent=True)
