import math

import pytest
from pyspark.sql import functions as F

from larder import params
from larder.functions import missing, nutrition, stats


def one(df):
    return df.collect()[0][0]


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


class TestMissing:
    def test_indicator_keeps_unknown(self, rows):
        df = rows("x double", (1.0,), (3.0,), (None,))
        assert column(df, missing.indicator(F.col("x") < 2)) == [1, 0, None]

    def test_blank_if_unknown_blanks(self, rows):
        df = rows("a int, x int", (1, 7), (0, 7), (None, 7))
        assert column(df, missing.blank_if(F.col("a") == 1, F.col("x"))) == [None, 7, None]

    def test_total_of_nothing_is_zero(self, rows):
        df = rows("g string, x double", ("a", None), ("b", 1.0), ("b", None))
        assert dict(df.groupBy("g").agg(missing.total(F.col("x"))).collect()) == {"a": 0.0, "b": 1.0}

    def test_outside_keeps_missing(self, rows):
        df = rows("x int", (1,), (2,), (None,))
        assert column(df.filter(missing.outside(F.col("x"), [1])), F.col("x")) == [2, None]
        assert df.filter(missing.outside(F.col("x"), [])).count() == 3

    def test_ratio_by_zero(self, rows):
        df = rows("x double, y double", (1.0, 0.0), (0.0, 0.0), (1.0, 2.0), (1.0, None))
        assert column(df, missing.ratio(F.col("x"), F.col("y"))) == [None, None, 0.5, None]

    def test_nan_becomes_null(self, rows):
        df = rows("x double", (float("nan"),), (1.0,), (None,))
        assert column(df, missing.drop_nan(F.col("x"))) == [None, 1.0, None]

    def test_row_mean(self, rows):
        df = rows("a double, b double", (1.0, 3.0), (1.0, None), (None, None))
        assert column(df, missing.row_mean([F.col("a"), F.col("b")])) == [2.0, 1.0, None]

    def test_percent_rounds_half_even(self, rows):
        df = rows("x double", (0.025,), (0.035,), (None,))
        assert column(df, missing.percent(F.col("x"), 0)) == [2.0, 4.0, None]
        assert column(df, missing.percent(F.col("x")))[0] == pytest.approx(2.5)


class TestStats:
    def test_normal_cdf(self, spark):
        df = spark.range(-2400, 2401).select((F.col("id") / 200).alias("x"))
        for x, p in stats.with_normal_cdf(df, {"p": F.col("x")}).collect():
            assert abs(p - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-15

    def test_normal_cdf_ends(self, rows):
        df = rows("x double", (40.0,), (-40.0,), (None,), (0.0,), (1e200,), (-1e200,))
        values = column(stats.with_normal_cdf(df, {"p": F.col("x")}), "p")
        assert values[:3] == [1.0, 0.0, None]
        assert values[3] == pytest.approx(0.5, abs=1e-15)
        assert values[4:] == [1.0, 0.0]

    def test_no_scores(self, rows):
        assert stats.with_normal_cdf(rows("x double", (1.0,)), {}).columns == ["x"]

    @pytest.mark.parametrize(("df_", "t"), [(10, 2.22813), (30, 2.04227), (100, 1.98397)])
    def test_t(self, spark, df_, t):
        assert one(spark.range(1).select(stats.t_975(F.lit(df_)))) == pytest.approx(t, abs=2e-5)


class TestNutrition:
    @pytest.mark.parametrize("bio", [5, 10, 15])
    def test_iron_edges(self, rows, bio):
        edges, bands = params.IRON_EDGES[bio], params.IRON_PROBABILITY
        cases = []
        for i, e in enumerate(edges):
            cases += [(e, bands[i]), (e - 1e-9, bands[i]), (e + 1e-9, bands[i + 1])]
        df = rows("x double, p double", *cases)
        got = df.select(nutrition.iron_inadequacy(F.col("x"), bio).alias("q"), "p").collect()
        assert all(r.q == r.p for r in got)

    def test_iron_unknown(self, rows):
        df = rows("x double", (None,), (3.0,))
        assert column(df, nutrition.iron_inadequacy(F.col("x"), 10)) == [None, 1.0]
        assert column(df, nutrition.iron_inadequacy(F.col("x"), 12)) == [None, None]

    def test_flags(self, rows):
        df = rows("zn_mg double", (10.2,), (10.1,), (None,))
        assert column(nutrition.below_requirement(df, ["zn_mg"]), "zn_mg_inadequate") == [0, 1, None]

    def test_adequacy_ratio_truncates(self, rows):
        df = rows("x double", (1.0,), (3.0,), (None,))
        assert column(df, nutrition.adequacy_ratio(F.col("x"), 2.0)) == [0.5, 1.0, None]

    def test_mar_over_available(self, rows):
        df = rows("zn_mg double, fe_mg double", (10.2, 11.2), (5.1, None), (None, None))
        got = nutrition.with_mar(df, ["zn_mg", "fe_mg"]).select("mar", "mar_inadequate").collect()
        assert [tuple(r) for r in got] == [(0.75, 0), (0.5, 1), (None, None)]

    def test_mpa(self, rows):
        n = [*params.VARIATION, "fe_mg"]
        schema = ", ".join(f"{c} double" for c in n)
        at_requirement = tuple(params.REQUIREMENT[c] for c in params.VARIATION)
        df = rows(schema, (*at_requirement, 100.0), (None, None, None, None, 1.0), (None,) * 5)
        got = nutrition.with_mpa(df).select("mpa", "flag", "mpi").collect()
        assert got[0].mpa == pytest.approx((4 * 0.5 + 1) / 5)
        assert (got[0].flag, got[0].mpi) == (0, pytest.approx(0.4))
        assert tuple(got[1]) == (0.0, 1, 1.0)
        assert tuple(got[2]) == (None, None, None)

    def test_iron_adequacy_only_at_ten_percent(self, rows):
        df = rows("fe_mg double", (8.0,))
        assert column(nutrition.with_adequacy_probabilities(df, 10, variation={}), "pa_fe_mg") == [pytest.approx(0.04)]
        assert column(nutrition.with_adequacy_probabilities(df, 5, variation={}), "pa_fe_mg") == [None]
