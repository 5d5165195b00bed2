import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.operators import ordering
from larder.operators.joins import SOLID_KEY, na_join, original_key, with_solid_key
from larder.sources.staging import stage


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


class TestJoins:
    def test_missing_matches_missing(self, rows):
        left = rows("k int, a string", (1, "x"), (None, "y"), (2, "z"))
        right = rows("k int, b string", (1, "p"), (None, "q"), (3, "r"))
        assert got(na_join(left, right, "k")) == got(rows("k int, a string, b string", (1, "x", "p"), (None, "y", "q"), (2, "z", None)))
        assert na_join(left, right, "k", "inner").count() == 2
        assert [r.k for r in na_join(left, right, "k", "left_anti").collect()] == [2]
        assert na_join(left, right, "k", "left_semi").count() == 2

    def test_full_keeps_keys_of_both(self, rows):
        left, right = rows("k int, a int", (1, 1), (None, 2)), rows("k int, b int", (None, 3), (4, 5))
        assert got(na_join(left, right, "k", "full")) == [(1, 1, None), (4, None, 5), (None, 2, 3)]

    def test_clash_is_refused(self, rows):
        a = rows("k int, v int", (1, 1))
        with pytest.raises(ValueError, match="both sides"):
            na_join(a, a, "k")

    def test_no_nested_loop(self, rows):
        left, right = rows("k int, a int", (1, 1)), rows("k int, b int", (1, 3))
        plan = na_join(left, right, "k")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan

    def test_solid_key_round_trip(self, rows):
        df = with_solid_key(rows("k string, v int", ("0", 1), (None, 2)), "k")
        assert df.groupBy(*SOLID_KEY).count().count() == 2
        assert got(df.select(original_key("k"), "v")) == [("0", 1), (None, 2)]


class TestOrdering:
    @pytest.mark.parametrize("by", [[], ["g"]])
    @pytest.mark.parametrize("n", [5, 7])
    def test_ntile(self, spark, by, n):
        df = spark.range(1003).select("id", (F.hash("id") % 50).alias("v"),
                                      F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"))
        w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("v", "id")
        expected = dict(df.select("id", F.ntile(n).over(w)).collect())
        actual = dict(ordering.ntile_exact(df, "v", n, ["id"], "q", by).select("id", "q").collect())
        assert actual == expected

    def test_ntile_leaves_missing_unranked(self, rows):
        df = rows("id int, v double", *[(i, None if i % 4 == 0 else float(i)) for i in range(20)])
        out = {r.id: r.q for r in ordering.ntile_exact(df, "v", 5, ["id"], "q").collect()}
        assert all((out[i] is None) == (i % 4 == 0) for i in range(20))
        assert sorted(v for v in out.values() if v) == sorted([1, 2, 3, 4, 5] * 3)

    def test_ntile_fewer_rows_than_groups(self, rows):
        df = rows("id int, v double", (1, 1.0), (2, 2.0), (3, 3.0))
        assert sorted(r.q for r in ordering.ntile_exact(df, "v", 5, ["id"], "q").collect()) == [1, 2, 3]

    def test_quantiles(self, spark):
        df = spark.range(777).select("id", (F.abs(F.hash("id")) % 90).cast("double").alias("v"), (F.col("id") % 5).alias("g"))
        mine = {r.g: r[1:] for r in ordering.quantiles_exact(df, "v", [0.25, 0.5, 0.9], ["id"], ["g"]).collect()}
        p = F.percentile("v", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.9)]))
        theirs = {r.g: tuple(r[1]) for r in df.groupBy("g").agg(p).collect()}
        assert mine.keys() == theirs.keys()
        for g in mine:
            assert mine[g] == pytest.approx(theirs[g])

    @pytest.mark.parametrize("few", [1, 40, 2000])
    def test_quantiles_of_small_and_large_groups(self, spark, few):
        """Whichever way a group takes by its size, and the rows in its brackets by theirs, quantiles are the same."""
        df = spark.range(6000).select("id", (F.abs(F.hash("id")) % 900).cast("double").alias("v"),
                                      F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"))
        at = (0.0, 0.25, 0.5, 0.9, 1.0)
        got_ = {r.g: r[1:] for r in ordering.quantiles_exact(df, "v", at, ["id"], ["g"], few=few).collect()}
        want = {r.g: tuple(r[1]) for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(x) for x in at]))).collect()}
        assert got_.keys() == want.keys() and all(got_[g] == pytest.approx(want[g]) for g in want)
        whole = tuple(ordering.quantiles_exact(df, "v", at, ["id"], few=few).first())
        assert whole == pytest.approx(tuple(df.agg(F.percentile("v", F.array(*[F.lit(x) for x in at]))).first()[0]))

    def test_small_groups_need_no_range_shuffle(self, spark):
        df = stage(spark.range(4000).select("id", (F.col("id") * 7 % 90).cast("double").alias("v"), (F.col("id") % 500).alias("g")))
        plan = ordering.quantiles_exact(df, "v", [0.5], ["id"], ["g"])._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "percentile" not in plan and plan.count("Exchange hashpartitioning") == 1

    def test_median_of_missing_only(self, rows):
        df = rows("id int, v double, g string", (1, None, "a"), (2, 4.0, "b"))
        assert got(ordering.quantiles_exact(df, "v", [0.5], ["id"], ["g"])) == [("b", 4.0)]

    def test_hot_group_is_spread(self, spark):
        """A group with most rows fills several partitions of the ranking, also when its values tie."""
        df = spark.range(40000).select("id", F.lit(1.0).alias("v"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            numbered = df.repartitionByRange(F.col("g").asc_nulls_first(), F.col("v").asc_nulls_first(), F.col("id").asc_nulls_first())
            spread = numbered.groupBy(F.spark_partition_id().alias("p")).count().collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(spread) == 4
        assert max(r["count"] for r in spread) < 20000

    def test_first_per_key(self, rows):
        df = rows("k int, a string, b int", (1, "y", 1), (1, "x", 2), (1, None, 9), (None, "q", 1), (None, "p", 2))
        assert got(ordering.first_per_key(df, "k", ["a", "b"])) == [(1, None, 9), (None, "p", 2)]
        with pytest.raises(ValueError):
            ordering.first_per_key(df, "k", ["a"])
