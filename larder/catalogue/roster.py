"""Roster to adult-female-equivalents, and wealth quintiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.catalogue import query, rounded
from larder.operators import afe, checks, wealth
from larder.operators.joins import na_join
from larder.sources.adapters import ISO3, SURVEY
from larder.sources.staging import stage


def _people(t):
    return afe.recode_sentinel(afe.clean_birth(afe.decode_roster(t.persons())))


@query("decode_roster", "roster", "SELECT hhid, roster_id, adm1, sex, res FROM roster")
def decode_roster(t):
    return afe.decode_roster(t.persons()).select("hhid", "roster_id", "adm1", "sex", "res")


@query("split_survey_date", "hh_date persons", """
    SELECT p.hhid, p.roster_id, d.date, TRY_CAST(substring(d.date, 1, 4) AS INTEGER) AS year,
           TRY_CAST(substring(d.date, 5, 2) AS INTEGER) AS month
    FROM persons p LEFT JOIN hh_date d ON p.interview_id IS NOT DISTINCT FROM d.interview_id""")
def split_survey_date(t):
    dates = afe.split_yyyymm(t.hh_date())
    return na_join(t.persons().select("hhid", "roster_id", "interview_id"), dates, "interview_id").drop("interview_id")


@query("attach_date", "hh_date persons", """
    SELECT p.hhid, p.roster_id, TRY_CAST(substring(d.date, 1, 4) AS INTEGER) AS year,
           TRY_CAST(substring(d.date, 5, 2) AS INTEGER) AS month
    FROM persons p LEFT JOIN hh_date d ON p.interview_id IS NOT DISTINCT FROM d.interview_id""")
def attach_date(t):
    return afe.attach_date(t.persons().drop("year", "month"), t.hh_date()).select("hhid", "roster_id", "year", "month")


@query("clean_birth", "born", "SELECT hhid, roster_id, year_birth, month_birth FROM born")
def clean_birth(t):
    return afe.clean_birth(t.persons()).select("hhid", "roster_id", "year_birth", "month_birth")


@query("sentinel_age", "people", "SELECT hhid, roster_id, age FROM people")
def sentinel_age(t):
    return afe.recode_sentinel(t.persons()).select("hhid", "roster_id", "age")


@query("under2_group", "under2", "SELECT hhid, roster_id, sex, age_months FROM under2")
def under2_group(t):
    return afe.under2(_people(t)).select("hhid", "roster_id", "sex", "age_months")


@query("children_group", "children_2_17", "SELECT hhid, roster_id, sex, age FROM children_2_17")
def children_group(t):
    """The anti-join form, valid whether or not the person key repeats."""
    people = _people(t)
    return afe.children(people, afe.under2(people)).select("hhid", "roster_id", "sex", "age")


def _kcal_sql(grp):
    return f"SELECT hhid, roster_id, round(kcal, 4) AS kcal FROM kcal WHERE grp = '{grp}'"


@query("kcal_under2", "kcal", _kcal_sql("under2"))
def kcal_under2(t):
    people = afe.under2(_people(t))
    return people.select("hhid", "roster_id", F.round(afe.kcal_under2(F.col("age_months")), 4).alias("kcal"))


@query("kcal_children", "kcal", _kcal_sql("child"))
def kcal_children(t):
    people = _people(t)
    children = afe.children(people, afe.under2(people))
    return children.select("hhid", "roster_id", F.round(afe.kcal_child(F.col("sex"), F.col("age")), 4).alias("kcal"))


@query("kcal_adults", "kcal", _kcal_sql("adult"))
def kcal_adults(t):
    people = afe.adults(_people(t))
    return people.select("hhid", "roster_id", F.round(afe.kcal_adult(F.col("sex"), F.col("age")), 4).alias("kcal"))


@query("household_afe", "hh_afe", "SELECT hhid, round(afe, 6) AS afe FROM hh_afe")
def household_afe(t):
    return rounded(afe.household_afe(_people(t)))


@query("household_information", "hh_info", """
    SELECT hhid, adm1, res, round(survey_wgt, 4) AS survey_wgt, year, month, round(afe, 6) AS afe FROM hh_info""")
def household_information(t):
    return rounded(rounded(afe.household_information(_people(t)), 4, "survey_wgt"), 6, "afe")


@query("consumption_per_hh", "per_hh", """
    SELECT hhid, round(cons_aeq_adj, 5) AS cons_aeq_adj, round(exp_aeq_month, 5) AS exp_aeq_month FROM per_hh""")
def consumption_per_hh(t):
    return rounded(wealth.consumption_per_hh(t.cons_agg(), t.persons()), 5)


def _per_hh(t):
    return wealth.consumption_per_hh(t.cons_agg(), t.persons())


@query("quintile_overall", "per_hh", """
    SELECT hhid, CAST(ntile(5) OVER (ORDER BY cons_aeq_adj, hhid) AS INTEGER) AS sep_quintile FROM per_hh""")
def quintile_overall(t):
    return wealth.quintile_overall(_per_hh(t)).select("hhid", "sep_quintile")


@query("quintile_by_residence", "per_hh hh", """
    SELECT p.hhid, h.res, CAST(ntile(5) OVER (PARTITION BY h.res ORDER BY p.cons_aeq_adj, p.hhid) AS INTEGER) AS res_quintile
    FROM per_hh p JOIN hh h ON p.hhid = h.hhid""")
def quintile_by_residence(t):
    placed = na_join(_per_hh(t), t.hh().select("hhid", "res"), "hhid")
    return wealth.quintile_by_residence(placed).select("hhid", "res", "res_quintile")


@query("household_table", "per_hh hh_info", f"""
    SELECT '{SURVEY}' AS survey, h.hhid, '{ISO3}' AS iso3, CAST(NULL AS VARCHAR) AS zone, h.adm1,
           CAST(NULL AS VARCHAR) AS adm2, CAST(NULL AS VARCHAR) AS ea, h.res, q.sep_quintile, q.res_quintile,
           h.year, h.month, round(h.survey_wgt, 4) AS survey_wgt, round(h.afe, 6) AS afe,
           round(q.exp_aeq_month, 5) AS pc_expenditure
    FROM hh_info h LEFT JOIN (
        SELECT p.hhid, p.exp_aeq_month, CAST(ntile(5) OVER (ORDER BY p.cons_aeq_adj, p.hhid) AS INTEGER) AS sep_quintile,
               CAST(ntile(5) OVER (PARTITION BY i.res ORDER BY p.cons_aeq_adj, p.hhid) AS INTEGER) AS res_quintile
        FROM per_hh p JOIN hh_info i ON p.hhid = i.hhid) q ON h.hhid = q.hhid""")
def household_table(t):
    hh = stage(afe.household_information(_people(t)))  # a row per household, read for the ranks and for the table
    done = wealth.finalise_households(hh, wealth.with_quintiles(_per_hh(t), hh), ISO3, SURVEY)
    return rounded(rounded(rounded(done, 4, "survey_wgt"), 6, "afe"), 5, "pc_expenditure")


@query("afe_vs_size", "kcal people", """
    WITH sized AS (SELECT p.hhid, p.hh_size, a.afe FROM (SELECT hhid, count(*) AS hh_size FROM people GROUP BY hhid) p
                   JOIN (SELECT hhid, sum(coalesce(kcal, 0) / 2291e0) AS afe FROM kcal GROUP BY hhid) a ON p.hhid = a.hhid)
    SELECT s.hh_size, count(*) AS n, round(avg(s.afe), 6) AS mean_afe, round(any_value(f.slope), 6) AS slope,
           round(any_value(f.corr), 6) AS corr
    FROM sized s, (SELECT regr_slope(afe, hh_size) AS slope, corr(afe, hh_size) AS corr FROM sized) f
    GROUP BY s.hh_size""")
def afe_vs_size(t):
    return rounded(checks.mean_by(_sized(t), "afe", "hh_size"))


def _sized(t):
    sized = afe.with_person_afe(_people(t)).groupBy("hhid").agg(
        F.count("*").alias("hh_size"), F.when(F.count("grp") > 0, F.coalesce(F.sum("afe"), F.lit(0.0))).alias("afe"))
    return sized.filter(F.col("afe").isNotNull())


POINTS = [x / 2 for x in range(0, 41)]


@query("afe_smooth", "kcal people", """
    WITH sums AS (SELECT p.hh_size AS x, count(*) AS n, sum(a.afe) AS s FROM (SELECT hhid, count(*) AS hh_size FROM people GROUP BY hhid) p
                  JOIN (SELECT hhid, sum(coalesce(kcal, 0) / 2291e0) AS afe FROM kcal GROUP BY hhid) a ON p.hhid = a.hhid GROUP BY p.hh_size),
    met AS (SELECT *, abs(x - x0) AS d FROM sums, (SELECT unnest(range(0, 41)) / 2e0 AS x0)),
    upto AS (SELECT *, sum(n) OVER (PARTITION BY x0 ORDER BY d) AS c FROM met),
    near AS (SELECT *, min(d) FILTER (c >= ceil(0.75e0 * (SELECT sum(n) FROM sums))) OVER (PARTITION BY x0) AS q, min(d) OVER (PARTITION BY x0) AS least FROM upto),
    weighed AS (SELECT x0, n, n * w AS wn, s * w AS ws, u FROM (SELECT *, CASE WHEN q = least THEN 1e0 ELSE pow(1 - pow(d / q, 3), 3) END AS w,
                CASE WHEN q = 0 THEN 0e0 ELSE (x - x0) / q END AS u FROM near WHERE CASE WHEN q = least THEN d = q ELSE d < q END)),
    m AS (SELECT x0, sum(n) AS n, count(*) AS k, sum(wn) AS a, sum(wn * u) AS b, sum(wn * u * u) AS c, sum(wn * u ** 3) AS d, sum(wn * u ** 4) AS e,
                 sum(ws) AS p, sum(ws * u) AS q, sum(ws * u * u) AS r FROM weighed GROUP BY x0)
    SELECT x0, CAST(n AS BIGINT) AS n, round(CASE WHEN k > 2 THEN (p * (c * e - d * d) - b * (q * e - d * r) + c * (q * d - c * r)) / (a * (c * e - d * d) - b * (b * e - c * d) + c * (b * d - c * c))
           WHEN k = 2 THEN (p * c - q * b) / (a * c - b * b) ELSE p / a END, 5) AS smooth_afe FROM m""")
def afe_smooth(t):
    """The smooth curve of adult equivalents over household size."""
    return rounded(checks.smooth(_sized(t), "afe", "hh_size", POINTS), 5, "smooth_afe").withColumnRenamed("at", "x0")


# Adult equivalents are not in the test tables: 1 from 15 years on, 0.3 and 0.03 a year below.
@query("afe_vs_adult_equiv", "kcal people", """
    WITH sized AS (
        SELECT p.hhid, p.adult_equiv, a.afe
        FROM (SELECT hhid, sum(CASE WHEN age < 15 THEN 30 + 3 * age ELSE 100 END) / 100e0 AS adult_equiv FROM people GROUP BY hhid) p
        JOIN (SELECT hhid, sum(coalesce(kcal, 0) / 2291e0) AS afe FROM kcal GROUP BY hhid) a ON p.hhid = a.hhid)
    SELECT s.adult_equiv, count(*) AS n, round(avg(s.afe), 6) AS mean_afe, round(any_value(f.slope), 6) AS slope,
           round(any_value(f.corr), 6) AS corr
    FROM sized s, (SELECT regr_slope(afe, adult_equiv) AS slope, corr(afe, adult_equiv) AS corr FROM sized) f
    GROUP BY s.adult_equiv""")
def afe_vs_adult_equiv(t):
    weight = F.when(F.col("age") < 15, 30 + 3 * F.col("age")).otherwise(100)
    sized = afe.with_person_afe(_people(t)).groupBy("hhid").agg(
        (F.sum(weight) / 100).alias("adult_equiv"), F.when(F.count("grp") > 0, F.coalesce(F.sum("afe"), F.lit(0.0))).alias("afe"))
    return rounded(checks.mean_by(sized.filter(F.col("afe").isNotNull()), "afe", "adult_equiv"), 6, "mean_afe", "slope", "corr")


@query("loglog_fit", "cons_agg", """
    SELECT count(*) AS n, round(regr_slope(ly, lx), 6) AS slope, round(corr(lx, ly), 6) AS corr
    FROM (SELECT ln(exp_aeq_month) AS lx, ln(cons_aeq_adj) AS ly FROM cons_agg
          WHERE exp_aeq_month > 0 AND cons_aeq_adj > 0) WHERE lx BETWEEN 0 AND 20 AND ly BETWEEN 0 AND 20""")
def loglog_fit(t):
    return rounded(checks.log_log_fit(t.cons_agg(), "cons_aeq_adj", "exp_aeq_month"))
