import os

import pytest
from pyspark.sql import functions as F

from cuewright.sources import bundle as B

COLS = "job_id string, name string, content string"


def rows(spark, path):
    return sorted(tuple(r) for r in B.read_bundle(spark, path).collect())


def test_a_bundle_gives_back_what_was_written(spark, tmp_path):
    path = str(tmp_path / "b")
    want = [(f"job_{i}", n, f"{n} of {i} é\n\n" * (i % 4)) for i in range(50) for n in ("a.srt", "b.json")] + [("long", "c", "xé" * 4_500_000), ("none", "c", None)]
    B.write_bundle(spark.createDataFrame(want, COLS).repartition(3), path)
    assert rows(spark, path) == sorted(want)
    assert len(os.listdir(f"{path}/parts")) == 6  # two files a task, not one a job


def test_overwrite_append_and_vacuum(spark, tmp_path):
    path = "file:" + str(tmp_path / "b")
    make = lambda *r: spark.createDataFrame(list(r), COLS).coalesce(1)
    B.write_bundle(make(("1", "a", "old"), ("1", "b", "old"), ("2", "a", "old")), path)
    B.write_bundle(make(("1", "a", "new"), ("3", "a", "new")), path, "append")
    # job 1 is replaced with all its artifacts
    assert rows(spark, path) == [("1", "a", "new"), ("2", "a", "old"), ("3", "a", "new")]
    B.write_bundle(make(("4", "a", "last")), path)
    assert rows(spark, path) == [("4", "a", "last")]
    assert len(os.listdir(tmp_path / "b" / "parts")) > 4
    B.vacuum(path)
    assert rows(spark, path) == [("4", "a", "last")] and len(os.listdir(tmp_path / "b" / "parts")) in (2, 4) and len(os.listdir(tmp_path / "b")) == 2


def test_a_failed_run_leaves_the_old_bundle(spark, tmp_path):
    path = str(tmp_path / "b")
    B.write_bundle(spark.createDataFrame([("1", "a", "old")], COLS), path)
    before = sorted(os.listdir(f"{path}/parts"))
    bad = spark.range(0, 40, 1, 4).select(F.col("id").alias("job_id"), F.lit("a").alias("name"), F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise("new").alias("content"))
    with pytest.raises(Exception, match="broken"):
        B.write_bundle(bad, path)
    assert rows(spark, path) == [("1", "a", "old")]
    assert sorted(os.listdir(f"{path}/parts")) == before and len(os.listdir(path)) == 2
    with pytest.raises(Exception, match="needs a job_id"):
        B.write_bundle(spark.createDataFrame([(None, "a", "x")], COLS), path)
    assert rows(spark, path) == [("1", "a", "old")]


def test_empty_and_missing_bundles(spark, tmp_path):
    path = str(tmp_path / "b")
    assert rows(spark, path) == []
    B.write_bundle(spark.createDataFrame([], COLS), path)
    assert rows(spark, path) == []
