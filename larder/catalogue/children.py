"""Supplementation coverage of children."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.catalogue import query, rounded
from larder.catalogue.intakes import s_wmean
from larder.operators import coverage
from larder.plans.reports import coverage_report
from larder.sources.adapters import DROP_REGIONS

ELIGIBLE = "(SELECT * FROM vas WHERE eligible_child = 1)"
BY_REGION = f"SELECT adm1, {s_wmean('vas_child', 'wt')} * 100 AS vas_coverage FROM {ELIGIBLE} GROUP BY adm1"
TITLE = "upper(substring(label, 1, 1)) || substring(label, 2)"
NAMED = f"""SELECT {TITLE} AS adm1, round_even(e.vas_coverage, 0) AS vas_coverage FROM ({BY_REGION}) e
            JOIN region_codes c ON e.adm1 = c.code WHERE NOT regexp_matches({TITLE}, 'Nation_2[34]')"""


@query("child_base", "vas", "SELECT event_id, round(wt, 6) AS wt, adm1, age FROM vas")
def child_base(t):
    return rounded(coverage.child_base(t.children()).select("event_id", "wt", "adm1", "age"))


@query("child_eligible", "vas", "SELECT event_id, eligible_child FROM vas")
def child_eligible(t):
    return coverage.eligible(coverage.child_base(t.children())).select("event_id", "eligible_child")


@query("dose_date", "vas", "SELECT event_id, dose_date FROM vas")
def dose_date(t):
    return coverage.dose_date(t.children()).select("event_id", "dose_date")


@query("months_since_dose", "vas", "SELECT event_id, round(months_since_vita, 6) AS months_since_vita FROM vas")
def months_since_dose(t):
    return rounded(coverage.months_since(coverage.dose_date(t.children())).select("event_id", "months_since_vita"))


@query("vas_child", "vas", "SELECT event_id, eligible_child, vas_child FROM vas")
def vas_child(t):
    return coverage.child_vas(t.children()).select("event_id", "eligible_child", "vas_child")


@query("vas_national", "vas", f"SELECT round({s_wmean('vas_child', 'wt')} * 100, 6) AS vas_coverage FROM {ELIGIBLE}")
def vas_national(t):
    return rounded(coverage.vas_coverage(coverage.child_vas(t.children())))


@query("vas_region", "vas", f"SELECT adm1, round(vas_coverage, 6) AS vas_coverage FROM ({BY_REGION})")
def vas_region(t):
    return rounded(coverage.vas_coverage(coverage.child_vas(t.children()), by_region=True))


def _named(t):
    by_region = coverage.vas_coverage(coverage.child_vas(t.children()), by_region=True)
    return coverage.vas_region_named(by_region, t.region_codes(), DROP_REGIONS.title())


@query("vas_region_named", "vas region_codes", NAMED)
def vas_region_named(t):
    return _named(t)


@query("coverage_report", "vas region_codes region_dim", f"""
    SELECT NULL AS adm1, round({s_wmean('vas_child', 'wt')} * 100, 6) AS vas_coverage, NULL AS target_class FROM {ELIGIBLE} UNION ALL
    SELECT r.adm1, n.vas_coverage, CASE WHEN n.vas_coverage >= 80 THEN '80% or above'
           WHEN n.vas_coverage < 80 THEN 'Below 80%' END AS target_class
    FROM (SELECT upper(substring(adm1, 1, 1)) || lower(substring(adm1, 2)) AS adm1 FROM region_dim) r
    LEFT JOIN ({NAMED}) n ON r.adm1 IS NOT DISTINCT FROM n.adm1""")
def coverage_report_(t):
    dim = t.region_dim().select(F.initcap("adm1").alias("adm1"))
    parts = coverage_report(t.children(), t.region_codes(), dim, DROP_REGIONS.title())
    none = F.lit(None).cast("string")
    national = rounded(parts["national"]).select(none.alias("adm1"), "vas_coverage", none.alias("target_class"))
    return national.unionByName(parts["region"].select("adm1", "vas_coverage", "target_class"))


@query("vas_target", "vas region_codes region_dim", f"""
    SELECT r.adm1, n.vas_coverage, CASE WHEN n.vas_coverage >= 80 THEN '80% or above'
           WHEN n.vas_coverage < 80 THEN 'Below 80%' END AS target_class
    FROM (SELECT upper(substring(adm1, 1, 1)) || lower(substring(adm1, 2)) AS adm1 FROM region_dim) r
    LEFT JOIN ({NAMED}) n ON r.adm1 IS NOT DISTINCT FROM n.adm1""")
def vas_target(t):
    """All regions of the region table, those without an estimate included."""
    dim = t.region_dim().select(F.initcap("adm1").alias("adm1"))
    return coverage.target_class(_named(t), dim)
