import math
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import indicators
from larder.operators.survey import SurveyDesign, gap, interaction, long, to_percent

random.seed(7)
DATA = [(i, random.choice("ab"), random.choice(["s1", "s2", "s3"]), random.uniform(0.5, 9),
         None if i % 17 == 0 else random.random() ** 2) for i in range(400)]


@pytest.fixture
def table(rows):
    return rows("id int, d string, h string, w double, x double", *DATA)


def direct(data, n_design=None):
    """Mean and error by the plain two-pass formula, one stratum."""
    used = [(w, x) for *_, w, x in data if x is not None]
    sw = sum(w for w, _ in used)
    m = sum(w * x for w, x in used) / sw
    n = n_design or len(data)
    return m, math.sqrt(n / (n - 1) * sum((w * (x - m) / sw) ** 2 for w, x in used))


class TestDesign:
    def test_unknown_weight_raises(self, table):
        with pytest.raises(ValueError):
            SurveyDesign(table, "hh_weight")

    def test_mean_skips_missing(self, table):
        assert SurveyDesign(table, "w").mean(["x"]).first().x == pytest.approx(direct(DATA)[0])

    def test_unweighted(self, table):
        known = [x for *_, x in DATA if x is not None]
        assert SurveyDesign(table, None).mean(["x"]).first().x == pytest.approx(sum(known) / len(known))

    def test_scale_of_weights_does_not_matter(self, table):
        scaled = table.withColumn("w", F.col("w") * 1000)
        a = SurveyDesign(table, "w").mean_ci("x").first()
        b = SurveyDesign(scaled, "w").mean_ci("x").first()
        assert tuple(a) == pytest.approx(tuple(b))

    def test_national_is_mean_of_regions(self, table):
        regions = table.groupBy("d").agg(F.sum(F.when(F.col("x").isNotNull(), F.col("w"))).alias("w"))
        parts = SurveyDesign(table, "w").mean(["x"], ["d"]).join(regions, "d")
        again = SurveyDesign(parts, "w").mean(["x"]).first().x
        assert again == pytest.approx(direct(DATA)[0])

    def test_null_weights(self, rows):
        df = rows("w double, x double", (None, 5.0), (1.0, 1.0), (3.0, 0.0))
        design = SurveyDesign(df, "w")
        check = design.check().first()
        assert (check.n_rows, check.null_weights, check.non_positive_weights) == (3, 1, 0)
        kept = SurveyDesign(df, "w", on_null="drop")
        assert kept.mean(["x"]).first().x == kept.mean_ci("x").first().x == 0.25
        for estimate in (lambda d: d.mean(["x"]), lambda d: d.mean_ci("x"), lambda d: d.mean_sets(["x"], [[]], {})):
            with pytest.raises(Exception, match="rows without a weight in w"):
                estimate(design).collect()
        unknown = rows("w double, x double", (None, None), (1.0, 1.0))  # no value, so no weight is needed
        assert SurveyDesign(unknown, "w").mean(["x"]).first().x == 1.0
        with pytest.raises(ValueError):
            SurveyDesign(df, "w", on_null="ignore")

    def test_zero_weights_give_no_estimate(self, rows):
        assert SurveyDesign(rows("w double, x double", (0.0, 1.0)), "w").mean(["x"]).first().x is None


class TestErrors:
    def test_national(self, table):
        m, se = direct(DATA)
        r = SurveyDesign(table, "w").mean_ci("x").first()
        assert (r.x, r.x_se) == pytest.approx((m, se))
        assert r.x_upp - r.x == pytest.approx(1.96593 * se, rel=1e-5)  # t at 399
        assert r.x - r.x_low == pytest.approx(r.x_upp - r.x)

    def test_domain_keeps_design_size(self, table):
        rows_ = {r.d: r for r in SurveyDesign(table, "w").mean_ci("x", ["d"]).collect()}
        for d in "ab":
            m, se = direct([r for r in DATA if r[1] == d], len(DATA))
            assert (rows_[d].x, rows_[d].x_se) == pytest.approx((m, se))

    def test_missing_rows_out_of_the_design(self, table):
        out = SurveyDesign(table, "w").mean_ci("x", ["d"], missing_counts=False).collect()
        complete = SurveyDesign(table, "w").complete(["x"]).mean_ci("x", ["d"]).collect()
        assert sorted(map(tuple, out)) == sorted(map(tuple, complete))

    def test_strata(self, table):
        for by in ([], ["d"]):
            result = SurveyDesign(table, "w", "h").mean_ci("x", by).collect()
            for r in result:
                domain = [row for row in DATA if not by or row[1] == r.d]
                m, _ = direct(domain)
                sw = sum(w for *_, w, x in domain if x is not None)
                total = 0.0
                for h in ("s1", "s2", "s3"):
                    z = [w * (x - m) / sw if x is not None and (not by or d == r.d) else 0.0
                         for _, d, hh, w, x in DATA if hh == h]
                    mean = sum(z) / len(z)
                    total += len(z) / (len(z) - 1) * sum((v - mean) ** 2 for v in z)
                assert (r.x, r.x_se) == pytest.approx((m, math.sqrt(total)))

    def test_constant_has_no_error(self, table):
        r = SurveyDesign(table.withColumn("x", F.lit(0.3)), "w").mean_ci("x").first()
        assert (r.x, r.x_se) == (pytest.approx(0.3), 0.0)

    def test_lone_row_in_stratum(self, rows):
        df = rows("h string, w double, x double", ("a", 1.0, 1.0), ("a", 1.0, 0.0), ("b", 1.0, 1.0))
        assert SurveyDesign(df, "w", "h").mean_ci("x").first().x_se is None

    def test_degrees_argument_and_rounding(self, table):
        r = SurveyDesign(table, "w").mean_ci("x", degrees=10, digits=3, out="m").first()
        assert r.m == round(direct(DATA)[0], 3)
        assert (r.m_upp - r.m_low) / 2 == pytest.approx(2.22814 * r.m_se, rel=1e-5)


class TestShapes:
    def test_sets_keep_missing_group_apart(self, rows):
        df = rows("q int, res string, w double, x double", (1, "U", 1.0, 1.0), (1, None, 1.0, 0.0))
        out = SurveyDesign(df, "w").mean_sets(["x"], [["q"], ["q", "res"]], {"res": "Overall"})
        assert {(r.q, r.res): r.x for r in out.collect()} == {(1, "Overall"): 0.5, (1, "U"): 1.0, (1, None): 0.0}

    def test_overall_rows_equal_plain_mean(self, table):
        sets = SurveyDesign(table, "w").mean_sets(["x"], [["h"], ["h", "d"]], {"d": "Overall"})
        plain = dict(SurveyDesign(table, "w").mean(["x"], ["h"]).collect())
        assert {r.h: r.x for r in sets.filter("d = 'Overall'").collect()} == pytest.approx(plain)

    def test_interaction(self, rows):
        df = rows("a string, b string", ("x", "y"), ("x", None))
        assert [r[0] for r in df.select(interaction("a", "b")).collect()] == ["x.y", None]

    def test_gap_drops_incomplete(self, rows):
        df = rows("q string, res string, estimate double", ("1", "U", 10.0), ("1", "R", 30.0), ("2", "U", 5.0))
        assert [tuple(r) for r in gap(df, "q", "res", "R", "U").collect()] == [("1", 30.0, 10.0, 20.0)]

    def test_long_and_percent(self, rows):
        df = to_percent(rows("g string, a double, b double", ("x", 0.1, 0.25)), ["a", "b"], 0)
        assert sorted(tuple(r) for r in long(df, ["g"]).collect()) == [("x", "a", 10.0), ("x", "b", 25.0)]


class TestIron:
    def test_one_unknown_intake(self, rows):
        df = rows("g string, w double, fe_mg double", ("a", 1.0, 1.0), ("a", 3.0, 100.0), ("b", 1.0, None), ("b", 1.0, 1.0))
        lenient = dict(indicators.fe_prevalence(df, "w", ["g"]).collect())
        assert lenient == {"a": 25.0, "b": 100.0}
        assert dict(indicators.fe_prevalence(df, "w", ["g"], strict=True).collect()) == {"a": 25.0, "b": None}
        assert dict(indicators.fe_prevalence(df, None, ["g"]).collect())["a"] == 50.0


def clustered(data, domain=None, strata=True, lonely="missing"):
    """Mean and error of rows (group, stratum, unit, weight, value) by the plain two-pass formula over units' totals."""
    mine = [(w, x) for d, _, _, w, x in data if x is not None and domain in (None, d)]
    sw = sum(w for w, _ in mine)
    m = sum(w * x for w, x in mine) / sw
    totals: dict = {}
    for d, h, u, w, x in data:
        z = w * (x - m) / sw if x is not None and domain in (None, d) else 0.0
        units = totals.setdefault(h if strata else 0, {})
        units[u] = units.get(u, 0.0) + z
    parts = []
    for units in totals.values():
        n, z = len(units), list(units.values())
        if n > 1:
            parts.append(n / (n - 1) * sum((t - sum(z) / n) ** 2 for t in z))
        elif any(z):
            parts.append({"missing": math.nan, "certainty": 0.0, "adjust": z[0] ** 2}[lonely])
    return m, math.sqrt(sum(parts)), sum(map(len, totals.values())) - len(totals)


class TestClusters:
    DATA = [(d, h, i % (4 + len(h) % 3), w, x) for i, d, h, w, x in DATA]
    SCHEMA = "d string, h string, u int, w double, x double"

    def test_against_two_passes(self, rows):
        df = rows(self.SCHEMA, *self.DATA)
        m, se, degrees = clustered(self.DATA)
        got = SurveyDesign(df, "w", "h", ids="u").mean_ci("x").first()
        assert (got.x, got.x_se) == pytest.approx((m, se))
        z, t = 1.959963984540054, (got.x_upp - got.x) / got.x_se
        assert t > z and t == pytest.approx((SurveyDesign(df, "w").mean_ci("x", degrees=degrees).first().x_upp - m) / direct(DATA)[1], rel=1e-6)
        without = SurveyDesign(df.withColumn("u", F.concat("h", "u")), "w", ids="u").mean_ci("x").first()
        assert without.x_se == pytest.approx(clustered([(d, h, h + str(u), w, x) for d, h, u, w, x in self.DATA], strata=False)[1])

    def test_domains_cross_units(self, rows):
        """A unit with rows in two domains is one unit of the design, and one without rows in a domain counts there as zero."""
        data = [*self.DATA, *[("a", "s1", 90 + i, 2.0, 0.5 + i / 9) for i in range(3)]]
        got = {r.d: r for r in SurveyDesign(rows(self.SCHEMA, *data), "w", "h", ids="u").mean_ci("x", ["d"]).collect()}
        for d in "ab":
            m, se, _ = clustered(data, d)
            assert (got[d].x, got[d].x_se) == pytest.approx((m, se))

    def test_one_unit_per_row_is_the_plain_design(self, table):
        for by in ([], ["d"]):
            plain = SurveyDesign(table, "w", "h").mean_ci("x", by).orderBy(*by or ["x"]).collect()
            units = SurveyDesign(table, "w", "h", ids="id").mean_ci("x", by).orderBy(*by or ["x"]).collect()
            for a, b in zip(plain, units, strict=True):
                assert [v for v in a if not isinstance(v, str)] == pytest.approx([v for v in b if not isinstance(v, str)])

    def test_missing_values(self, rows):
        """Units whose rows have no values stay in the design as zeros, or are left out."""
        data = [*self.DATA, *[("a", "s1", 50 + i, 1.0, None) for i in range(4)]]
        df = rows(self.SCHEMA, *data)
        assert SurveyDesign(df, "w", "h", ids="u").mean_ci("x").first().x_se == pytest.approx(clustered(data)[1])
        known = [r for r in data if r[-1] is not None]
        assert SurveyDesign(df, "w", "h", ids="u").mean_ci("x", missing_counts=False).first().x_se == pytest.approx(clustered(known)[1])

    @pytest.mark.parametrize("lonely", ["missing", "certainty", "adjust"])
    def test_lonely_units(self, rows, lonely):
        data = [*self.DATA, *[("a", "alone", 7, 1.5, 0.9), ("b", "alone", 7, 2.5, 0.1)]]
        got = SurveyDesign(rows(self.SCHEMA, *data), "w", "h", ids="u").mean_ci("x", lonely=lonely).first()
        if lonely == "missing":
            assert got.x_se is None and got.x_low is None and got.x is not None
        else:
            assert got.x_se == pytest.approx(clustered(data, lonely=lonely)[1])
        with pytest.raises(ValueError):
            SurveyDesign(rows(self.SCHEMA, *data), "w").mean_ci("x", lonely="remove")

    def test_constant_has_no_error(self, rows):
        df = rows(self.SCHEMA, *[(d, h, u, w, 0.3) for d, h, u, w, _ in self.DATA])
        assert SurveyDesign(df, "w", "h", ids="u").mean_ci("x").first().x_se == 0

    def test_unknown_units(self, rows):
        df = rows(self.SCHEMA, *self.DATA, ("a", "s1", None, 1.0, 0.5))
        with pytest.raises(Exception, match="rows without a unit in u"):
            SurveyDesign(df, "w", "h", ids="u").mean_ci("x").collect()
        got = SurveyDesign(df, "w", "h", on_null="drop", ids="u").mean_ci("x").first()
        assert got.x_se == pytest.approx(clustered(self.DATA)[1])
        with pytest.raises(ValueError):
            SurveyDesign(df, "w", ids="ea")

    def test_check(self, rows):
        df = rows(self.SCHEMA, *self.DATA, ("a", "alone", 1, 1.0, 0.5), ("a", "s1", None, 1.0, 0.5), ("a", "s2", 1, None, None))
        got = SurveyDesign(df, "w", "h", ids="u").check().first()
        units = {(h, u) for _, h, u, _, _ in self.DATA}
        assert (got.n_rows, got.null_weights, got.null_ids, got.n_units, got.lonely_strata) == (403, 1, 1, len(units) + 1, 1)

    def test_hot_unit_is_summed_before_it_moves(self, spark):
        """The units' totals are one scan, summed in each task first."""
        df = spark.range(100_000).selectExpr("IF(id < 90000, 0, id % 50) AS u", "id % 4 AS h", "1D + id % 3 AS w", "CAST(id % 7 AS DOUBLE) AS x")
        design = SurveyDesign(df, "w", "h", ids="u")
        rows = df.select("h", F.col("u").alias("_unit"), F.col("x").alias("_x"), (F.col("w") * F.col("x")).alias("_wx"), F.col("w").alias("_w"),
                         F.lit(True).alias("_weighed"), F.lit(False).alias("_unweighed"))
        plan = design._units(rows, [], ["h"], F.count_if("_weighed"))._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("Exchange hashpartitioning"):]
        assert plan.count("Exchange") == 1 and "HashAggregate(keys=[h" in below and "partial_sum" in below
        got = design.mean_ci("x")
        assert "Range" not in got._jdf.queryExecution().executedPlan().toString()
        data = [(None, i % 4, 0 if i < 90_000 else i % 50, 1.0 + i % 3, float(i % 7)) for i in range(100_000)]
        assert got.first().x_se == pytest.approx(clustered(data)[1])
