"""Stored quantile sketches: merging rounds, error on a hot item, odd values."""

import math

import pytest
from pyspark.sql import functions as F

from larder.operators import sketches
from larder.sources.tables import write_table


def ranks(df, found, column):
    """Rows below and up to the estimate of each key, as shares of the key's rows."""
    both = df.join(found, df["item_code"].eqNullSafe(found["of"]))
    out = both.groupBy("of").agg(F.avg((F.col("quantity_g") < F.col(column)).cast("double")).alias("low"), F.avg((F.col("quantity_g") <= F.col(column)).cast("double")).alias("high"))
    return {r.of: (r.low, r.high) for r in out.collect()}


def test_merged_rounds_on_a_hot_item(spark, tmp_path):
    """An item with most of the rows: rounds merged from files are as good as one pass over all."""
    df = spark.range(200_000, numPartitions=8).select(F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id") % 300).cast("int").alias("item_code"),
                                                      (F.abs(F.hash("id")) % 99_991 / 7).alias("quantity_g"), (F.col("id") % 3).alias("round"))
    stored = []
    for r in range(3):
        path = write_table(sketches.sketched(df.filter(F.col("round") == r)), str(tmp_path), f"round{r}")
        stored.append(spark.read.parquet(path))
    merged = sketches.merged(*stored)
    sizes = {r.item_code: r.n for r in merged.collect()}
    assert sizes == {r.item_code: r["count"] for r in df.groupBy("item_code").count().collect()} and max(sizes.values()) == 140_000
    for one in (merged, sketches.sketched(df)):
        found = sketches.quantiles(one, [0.1, 0.5, 0.9], ["a", "b", "c"]).withColumnRenamed("item_code", "of")
        for p, column in ((0.1, "a"), (0.5, "b"), (0.9, "c")):
            off = [max(0.0, low - p, p - high) for low, high in ranks(df, found, column).values()]
            assert max(off) <= 2 * sketches.rank_error() and sum(x > sketches.rank_error() for x in off) <= 0.02 * len(off)
    assert sketches.merged(merged).select("sketch").agg(F.max(F.length("sketch"))).first()[0] < 30_000


def test_few_values_are_exact(rows):
    data = [(i % 4, float((i * 37) % 101)) for i in range(150)] + [(9, 5.0), (None, 1.0), (None, 3.0), (7, None), (8, math.nan)]
    df = rows("item_code int, quantity_g double", *data)
    found = {r.item_code: (r.n, r["q0.5"]) for r in sketches.quantiles(sketches.merged(sketches.sketched(df.limit(80)), sketches.sketched(df.subtract(df.limit(80)))), [0.5]).collect()}
    by: dict = {}
    for key, value in set(data):
        if value is not None and not math.isnan(value):
            by.setdefault(key, []).append(value)
    assert {k: v[1] for k, v in found.items()} == {k: sorted(v)[math.ceil(len(v) / 2) - 1] for k, v in by.items()}


def test_imputing(rows):
    df = rows("hhid int, item_code int, quantity_g double", (1, 1, 2.0), (2, 1, None), (3, 1, 4.0), (4, 1, 9.0), (5, None, None), (6, None, 8.0), (7, 2, None))
    got = {r.hhid: r.quantity_g for r in sketches.impute_from(df, sketches.sketched(df)).collect()}
    assert got == {1: 2.0, 2: 4.0, 3: 4.0, 4: 9.0, 5: 8.0, 6: 8.0, 7: None}


def test_no_range_shuffle_and_partial_sketches(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("item_code"), F.col("id").cast("double").alias("quantity_g"))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (sketches.sketched(df), sketches.impute_from(df, sketches.sketched(df)))]
    assert "partial_kll_sketch_agg_double" in plans[0] and not any("rangepartitioning" in x for x in plans)


def test_error_bound():
    assert sketches.rank_error(200) == pytest.approx(0.0133, abs=1e-4)
