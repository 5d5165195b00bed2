"""Row accounting on the running job."""

import pytest
from pyspark.sql import functions as F

from larder.operators.accounting import Account
from larder.sources.staging import stage


def test_counts_equal_separate_queries(spark):
    account = Account()
    base = stage(spark.range(10_000).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 50).alias("x"), (F.col("id") % 3).alias("g")))
    kept = account.keep(base, "small", F.col("x") < 40)
    blanked = account.blank(kept, "outlier", "x", F.col("x") > 30)
    full = account.fill(blanked, "fill", "x", F.when(F.col("g") > 0, F.lit(1)))
    out = stage(account.complete(full, "complete", ["x", "g"]))
    small = base.filter("x < 40")
    n, over = small.count(), small.filter("x > 30").count()
    filled = small.filter("x > 30 AND g > 0").count()
    assert account.counts() == {"small": (10_000, 10_000 - n), "outlier": (n, over), "fill": (n, filled), "complete": (n, over - filled)}
    assert out.count() == n - (over - filled)
    assert [tuple(r) for r in account.table(spark).collect()][:2] == [("small", "dropped", 10_000, 10_000 - n), ("outlier", "blanked", n, over)]


def test_one_scan(spark):
    account = Account()
    base = stage(spark.range(100).withColumn("x", F.col("id") % 5))
    df = account.blank(account.keep(base, "a", F.col("x") > 1), "b", "x", F.col("x") > 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("CollectMetrics") == 2 and "Exchange" not in plan


def test_missing_and_empty(spark, rows):
    account = Account()
    df = rows("x int, y int", (1, None), (None, 1), (None, None), (3, 3))
    stage(account.complete(account.blank(df, "blank", "x", F.col("x") > 2), "both", ["x", "y"]))
    stage(account.keep(df.limit(0), "none", F.col("x") > 0))
    assert account.counts() == {"blank": (4, 1), "both": (4, 4), "none": (0, 0)}
    with pytest.raises(ValueError):
        account.keep(df, "both", F.col("x") > 0)
