"""Stages that are written again: versioned folders, and a manifest that names the one to read.

A stage's folder holds one folder per version and ``_manifests/<number>``. A writer fills a folder
that no manifest names yet, then puts the manifest there under a temporary name and renames it: until
that moment readers see the old version, and a writer that is killed leaves nothing that anyone reads. A
reader is pinned to the version it opened, whatever is written meanwhile; so a job may replace the
very stage it reads. Two writers cannot both publish one number: the second one fails and may try again.

Old versions stay until ``remove_old`` takes those that were replaced long enough ago for every reader to be done.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    format: str
    written: float  # seconds since 1970
    schema: str


class Conflict(RuntimeError):
    """Another writer published the same number first."""


class _Store:
    """The few file operations needed, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> dict[str, float]:
        """What lies in a folder, with the time of its last change."""
        if not self.fs.exists(self.path(name)):
            return {}
        return {x.getPath().getName(): x.getModificationTime() / 1000 for x in self.fs.listStatus(self.path(name))}

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """A whole file or none under ``name``; fails if there is one."""
        draft = f"{MANIFESTS}/.draft-{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            # Some file systems overwrite on rename: look first, as far as that helps there.
            if self.fs.exists(self.path(name)) or not self.fs.rename(self.path(draft), self.path(name)):
                raise Conflict(f"{self.root}: {name} is there already")
        except (Conflict, Py4JJavaError):
            self.fs.delete(self.path(draft), False)
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _root(path: str, stage: str) -> str:
    return f"{path.rstrip('/')}/stage={stage}"


def versions(spark: SparkSession, path: str, stage: str) -> list[Version]:
    """The published versions of a stage, oldest first."""
    store = _Store(spark, _root(path, stage))
    names = sorted(n for n in store.names(MANIFESTS) if n.isdigit())
    return [Version(**json.loads(store.read(f"{MANIFESTS}/{n}"))) for n in names]


def replace_table(df: DataFrame, path: str, stage: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                  expected: int | None = None) -> Version:
    """Write ``df`` as the next version of a stage and publish it.

    ``expected`` is the number of the version that the new one was made from: if another one was published since, this fails.
    """
    spark = df.sparkSession
    store = _Store(spark, _root(path, stage))
    known = versions(spark, path, stage)
    last = known[-1].number if known else 0
    if expected is not None and expected != last:
        raise Conflict(f"{store.root}: version {last} is there, {expected} was expected")
    folder = f"v-{uuid.uuid4().hex}"
    df.write.format(fmt).partitionBy(*partition_by).save(f"{store.root}/{folder}")
    version = Version(last + 1, folder, fmt, time.time(), df.schema.json())
    store.publish(f"{MANIFESTS}/{version.number:012d}", json.dumps(version.__dict__))
    return version


def read_version(spark: SparkSession, path: str, stage: str, number: int | None = None) -> DataFrame:
    """The newest version of a stage as of now, or the one of that number; later versions do not change what this reads."""
    from pyspark.sql.types import StructType

    known = versions(spark, path, stage)
    found = known[-1:] if number is None else [v for v in known if v.number == number]
    if not found:
        raise FileNotFoundError(f"{_root(path, stage)} has no version {'' if number is None else number}".rstrip())
    version = found[0]
    return spark.read.schema(StructType.fromJson(json.loads(version.schema))).format(version.format).load(f"{_root(path, stage)}/{version.folder}")


def remove_old(spark: SparkSession, path: str, stage: str, older_than: float, keep: int = 1) -> list[str]:
    """Remove what no reader needs: versions replaced more than ``older_than`` seconds ago, all but the last ``keep``, and
    folders of that age that no manifest names (killed writers'). Returns their names."""
    store = _Store(spark, _root(path, stage))
    known, limit = versions(spark, path, stage), time.time() - older_than
    # A version is in use from when it was published until its successor was.
    old = [v for v, successor in zip(known, known[1:], strict=False) if successor.written < limit][: max(0, len(known) - max(1, keep))]
    gone = [v.folder for v in old]
    for v in old:
        store.delete(f"{MANIFESTS}/{v.number:012d}")
    named = {v.folder for v in known}
    gone += [n for n, changed in store.names().items() if n.startswith("v-") and n not in named and changed < limit]
    for folder in gone:
        store.delete(folder)
    for n, changed in store.names(MANIFESTS).items():
        if n.startswith(".draft-") and changed < limit:
            store.delete(f"{MANIFESTS}/{n}")
    return gone
