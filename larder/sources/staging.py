"""Where intermediate results go when lineage has to be cut, and who removes them.

The folder is the one the cluster names in ``spark.checkpoint.dir``: shared storage, so that
a lost executor does not lose the stage. Where that is unset, it is a folder of the
warehouse, which is shared too. Stages made inside ``owned`` are removed at its end; each thread
owns what it made.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL = threading.local()


def _owners() -> list[list[str]]:
    if not hasattr(_LOCAL, "owners"):
        _LOCAL.owners = []
    return _LOCAL.owners


def staging_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages").rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A path under the staging folder that no other job uses."""
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _owners():
        _owners()[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what was staged inside. Frames that read those stages must be used up by then."""
    paths: list[str] = []
    _owners().append(paths)
    try:
        yield
    finally:
        _owners().pop()
        for path in paths:
            remove(spark, path)


def stage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the staging folder and continue from there. This is an action: it runs a job.

    Written as Parquet rather than as an RDD checkpoint: the rows are computed once
    (a checkpoint computes them twice), and later readers get column pruning, file
    statistics for join planning, and pushed filters.
    """
    path = stage_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
