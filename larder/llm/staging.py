"""Stages of this package, and frames whose size decides how they are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.sources.staging import remove, stage_path

BROADCAST_ROWS = 1 << 19


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` (this runs a job) and continue from the files: lineage ends there, and every reader sees the same rows."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a stage that nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        remove(df.sparkSession, folder)


def sent_if_small(stage: DataFrame, rows: int = BROADCAST_ROWS, weight: str | None = None) -> DataFrame:
    """A narrow stage, to be broadcast if it is counted to hold at most ``rows`` rows (or entries of the array
    ``weight``), to be shuffled otherwise."""
    counted = stage.count() if weight is None else stage.agg(F.sum(F.size(weight))).first()[0] or 0
    return F.broadcast(stage) if counted <= rows else stage
