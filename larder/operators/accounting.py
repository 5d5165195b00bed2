"""Row accounting: what each cleaning rule drops or blanks, counted on the job that runs anyway.

Every rule of an ``Account`` is the plain filter or blanking with an observation in front: Spark counts the
rows that pass through as it computes the result, so there is no second scan and no extra job. The counts are
there once a frame that went through the rule has been written (or otherwise run); ``table`` waits for that.

A rule counts per run of its frame: stage a frame that several others read, else its first run counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("rule", T.StringType(), False), T.StructField("effect", T.StringType(), False),
                       T.StructField("n_rows", T.LongType(), False), T.StructField("n_changed", T.LongType(), False)])


class Account:
    """The rules of one job, in the order in which they were stated."""

    def __init__(self) -> None:
        self._rules: dict[str, tuple[str, Observation]] = {}

    def _watched(self, df: DataFrame, rule: str, effect: str, changed: Column) -> DataFrame:
        if rule in self._rules:
            raise ValueError(f"rule {rule} is stated twice")
        seen = Observation(f"{rule}")
        self._rules[rule] = (effect, seen)
        return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(changed).alias("n_changed"))

    def keep(self, df: DataFrame, rule: str, condition: Column) -> DataFrame:
        """Rows for which ``condition`` holds; where it is missing the row drops, as in any filter."""
        return self._watched(df, rule, "dropped", ~F.coalesce(condition, F.lit(False))).filter(condition)

    def complete(self, df: DataFrame, rule: str, columns: Sequence[str]) -> DataFrame:
        """Rows with every one of ``columns`` present."""
        return self.keep(df, rule, reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))

    def blank(self, df: DataFrame, rule: str, column: str, condition: Column) -> DataFrame:
        """``column`` made missing where ``condition`` holds; a value that is missing already does not count."""
        hit = F.coalesce(condition, F.lit(False)) & F.col(column).isNotNull()
        return self._watched(df, rule, "blanked", hit).withColumn(column, F.when(~hit, F.col(column)))

    def fill(self, df: DataFrame, rule: str, column: str, value: Column) -> DataFrame:
        """``value`` where ``column`` is missing, counted where there is one."""
        return self._watched(df, rule, "filled", F.col(column).isNull() & value.isNotNull()).withColumn(column, F.coalesce(F.col(column), value))

    def counts(self) -> dict[str, tuple[int, int]]:
        """Rows that came to each rule, and those that it changed. Waits until every rule's frame has run."""
        return {rule: (seen.get["n_rows"], seen.get["n_changed"]) for rule, (_, seen) in self._rules.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """``counts`` as a frame, a row per rule."""
        found = self.counts()
        return spark.createDataFrame([(rule, effect, *found[rule]) for rule, (effect, _) in self._rules.items()], SCHEMA)
