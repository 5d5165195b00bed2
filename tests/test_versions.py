"""Stages written again: killed writers, pinned readers, conflicts, removal by age."""

import os
import signal
import subprocess
import sys
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from larder.sources import versions
from larder.sources.versions import read_version, remove_old, replace_table


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "survey")


def numbers(spark, n):
    return spark.range(n).withColumn("g", F.col("id") % 3)


def test_replace_and_read(spark, place):
    with pytest.raises(FileNotFoundError):
        read_version(spark, place, "hh")
    replace_table(numbers(spark, 5), place, "hh")
    pinned = read_version(spark, place, "hh")
    replace_table(numbers(spark, 9), place, "hh", partition_by=["g"])
    assert (pinned.count(), read_version(spark, place, "hh").count(), read_version(spark, place, "hh", 1).count()) == (5, 9, 5)
    assert read_version(spark, place, "hh").columns == ["id", "g"]


def test_a_job_replaces_what_it_reads(spark, place):
    replace_table(numbers(spark, 6), place, "hh")
    for _ in range(2):
        now = read_version(spark, place, "hh")
        replace_table(now.unionByName(now), place, "hh")
    assert [read_version(spark, place, "hh", n).count() for n in (1, 2, 3)] == [6, 12, 24]


def test_failed_writer_leaves_the_old_version(spark, place):
    replace_table(numbers(spark, 4), place, "hh")
    bad = numbers(spark, 100).withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.lit("")))
    with pytest.raises(Exception, match="no"):
        replace_table(bad, place, "hh")
    assert read_version(spark, place, "hh").count() == 4 and len(versions.versions(spark, place, "hh")) == 1


def test_killed_writer_leaves_the_old_version(spark, place):
    """A process that is killed while its rows are being written."""
    replace_table(numbers(spark, 4), place, "hh")
    code = textwrap.dedent(f"""
        import time
        from larder.session import local_session
        from larder.sources.versions import replace_table
        spark = local_session(2, "killed")
        def slow(batches):
            for b in batches:
                print("writing", flush=True)
                time.sleep(600)
                yield b
        replace_table(spark.range(10).mapInArrow(slow, "id long"), {place!r}, "hh")
    """)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.Popen([sys.executable, "-c", code], cwd=root, env=os.environ | {"LARDER_DRIVER_MEMORY": "1g", "PYTHONPATH": root},
                           stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, start_new_session=True)
    try:
        folder = f"{place}/stage=hh"
        end = time.time() + 120
        while time.time() < end and len([x for x in os.listdir(folder) if x.startswith("v-")]) < 2:
            time.sleep(0.2)
        assert len([x for x in os.listdir(folder) if x.startswith("v-")]) == 2
    finally:
        os.killpg(run.pid, signal.SIGKILL)  # the group that this test started
        run.wait()
    assert read_version(spark, place, "hh").count() == 4
    assert replace_table(numbers(spark, 7), place, "hh").number == 2 and read_version(spark, place, "hh").count() == 7
    assert remove_old(spark, place, "hh", older_than=3600) == []
    assert len(remove_old(spark, place, "hh", older_than=-5)) == 2
    assert read_version(spark, place, "hh").count() == 7 and len([x for x in os.listdir(folder) if x.startswith("v-")]) == 1


def test_two_writers(spark, place, monkeypatch):
    first = replace_table(numbers(spark, 1), place, "hh")
    before = versions.versions(spark, place, "hh")
    replace_table(numbers(spark, 2), place, "hh", expected=first.number)
    with pytest.raises(versions.Conflict):
        replace_table(numbers(spark, 3), place, "hh", expected=first.number)
    monkeypatch.setattr(versions, "versions", lambda *a: before)  # a writer that had looked before the other published
    with pytest.raises(versions.Conflict):
        replace_table(numbers(spark, 3), place, "hh")
    monkeypatch.undo()
    assert read_version(spark, place, "hh").count() == 2
    assert not [x for x in os.listdir(f"{place}/stage=hh/_manifests") if x.startswith(".draft")]


def test_removal_by_age(spark, place):
    for n in range(1, 5):
        replace_table(numbers(spark, n), place, "hh")
    assert remove_old(spark, place, "hh", older_than=3600) == []
    assert len(remove_old(spark, place, "hh", older_than=-5, keep=2)) == 2
    assert [v.number for v in versions.versions(spark, place, "hh")] == [3, 4]
    assert replace_table(numbers(spark, 9), place, "hh").number == 5
