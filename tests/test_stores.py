"""Stores that lose old rows, and stored models."""

from datetime import datetime

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sessionlens.session import scratch_path
from sessionlens.sources import claims, export, registry


@pytest.fixture
def store(spark):
    path = scratch_path(spark, "store")
    rows = spark.range(240).select("id", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, id)").alias("ts"))
    export.write_rolling(rows.withColumn("day", F.to_date("ts")).repartition("day"), path)
    return path


def test_old_days_are_deleted(spark, store):
    assert export.expire_old_days(spark, store, 3) == [f"2024-01-0{d}" for d in range(1, 8)]
    assert spark.read.parquet(store).count() == 72 and len(export.day_folders(spark, store)) == 3


def test_rows_before_the_limit_are_removed(spark, store):
    export.expire_before(spark, store, "id LONG, ts TIMESTAMP", datetime(2024, 1, 10, 12), days=4)
    left = [r.id for r in spark.read.schema("id LONG, ts TIMESTAMP, day DATE").parquet(store).collect()]
    assert sorted(left) == list(range(5 * 24 + 12, 240)) and min(export.day_folders(spark, store)) == "2024-01-06"


def test_a_hot_day_is_written_by_many_tasks(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") < 8000, "2024-01-01").when(F.col("id") < 8990, "2024-01-02").cast("date").alias("day"))
    dealt = export.dealt_by_day(rows, rows_per_task=500)
    assert dealt.columns == rows.columns and sorted(r.id for r in dealt.collect()) == list(range(9000))
    path = scratch_path(spark, "hot")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        export.write_rolling(dealt, path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = spark.read.parquet(path).select("day", F.input_file_name().alias("f")).distinct().groupBy("day").count().collect()
    assert {str(r.day): r["count"] > 1 for r in files if r.day}["2024-01-01"]


def test_two_savers_never_take_one_version(spark):
    root = scratch_path(spark, "models")
    rows = spark.range(20).select(F.col("id").cast("double").alias("x"), (F.col("id") > 9).cast("double").alias("label"))
    model = DecisionTreeClassifier(maxDepth=1, seed=1).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows))
    assert claims.create_once(spark, f"{root}/_claims/tree-v1", "tree")  # another saver is at work on version 1
    assert registry.save(spark, model, root, "tree") == 2 and registry.save(spark, model, root, "other") == 1


def test_models_are_versioned_checked_and_switched(spark):
    root = scratch_path(spark, "models")
    rows = spark.range(40).select(F.col("id").cast("double").alias("x"), (F.col("id") > 20).cast("double").alias("label"))
    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    fit = lambda depth: DecisionTreeClassifier(maxDepth=depth, seed=1).fit(vectors)
    assert registry.save(spark, fit(1), root, "tree") == 1
    assert registry.save(spark, fit(2), root, "tree") == 2
    assert registry.save(spark, fit(0), root, "tree", shadow=True) == 3
    flags = {r.version: (r.active, r.shadow) for r in registry.entries(spark, root).collect()}
    assert flags == {1: (False, False), 2: (True, False), 3: (False, True)}
    model = registry.load(spark, root, "tree")
    assert model.transform(vectors).filter("prediction != label").isEmpty()
    registry.activate(spark, root, "tree", 3)
    flags = {r.version: (r.active, r.shadow) for r in registry.entries(spark, root).collect()}
    assert flags == {1: (False, False), 2: (False, False), 3: (True, False)}
    assert registry.load(spark, root, "tree").depth == 0 and registry.load(spark, root, "tree", 1).depth == 1
    spark.range(1).write.mode("append").parquet(f"{root}/tree/v1/data")
    with pytest.raises(ValueError, match="checksum"):
        registry.load(spark, root, "tree", 1)
    with pytest.raises(KeyError):
        registry.load(spark, root, "tree", 9)
