"""The evolving log and the layout for lookups."""

import pytest
from pyspark.sql import functions as F

from labelscan.sources import layout
from labelscan.sources.registry import Registry


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_upgrades_a_log_without_losing_records(spark, tmp_path):
    log = Registry(spark, f"file://{tmp_path}/log")
    log.create("id string, filename string, n int")
    log.append(spark.createDataFrame([("a", "a.png", 1)], "id string, filename string, n int"))
    log.add("product_name", "string")
    log.add("reviewer_status", "string", "'NONE'")
    assert rows(log.read()) == {("a", "a.png", 1, None, "NONE")}
    log.append(spark.createDataFrame([("b", "Tea", None), ("c", None, "PENDING")], "id string, product_name string, reviewer_status string"))
    log.append(spark.createDataFrame([("d",)], "id string"))
    assert rows(log.read()) == {("a", "a.png", 1, None, "NONE"), ("b", None, None, "Tea", None), ("c", None, None, None, "PENDING"), ("d", None, None, None, "NONE")}


def test_renamed_and_dropped_columns(spark, tmp_path):
    log = Registry(spark, f"file://{tmp_path}/log")
    log.create("id int, name string")
    log.append(spark.createDataFrame([(1, "x")], "id int, name string"))
    log.rename("name", "title")
    log.append(spark.createDataFrame([(2, "y")], "id int, title string"))
    log.add("name", "int", "7")
    assert rows(log.read()) == {(1, "x", 7), (2, "y", 7)} and log.read().columns == ["id", "title", "name"]
    log.drop("title")
    log.add("title", "string")
    assert rows(log.read()) == {(1, 7, None), (2, 7, None)}
    for wrong in (lambda: log.add("id", "int"), lambda: log.rename("none", "x"), lambda: log.rename("id", "title"), lambda: log.append(spark.range(1).toDF("odd"))):
        with pytest.raises(ValueError):
            wrong()
    plan = log.read().select("id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "ReadSchema: struct<c0:int>" in plan


def scanned(df):
    """What a lookup found, and the files and rows that its scan gave."""
    found = rows(df)
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return found, *(leaf.metrics().get(m).get().value() for m in ("numFiles", "numOutputRows"))


def test_lookups_skip_files_and_row_groups(spark, tmp_path):
    path = f"file://{tmp_path}/decisions"
    df = spark.range(40_000).select((F.col("id") * 2).alias("id"), F.concat(F.lit("decision "), F.col("id").cast("string")).alias("said"))
    layout.write_for_lookup(df, path, "id", 16, 4_000)
    for value in (0, 4_444, 79_998):
        found, files, read = scanned(layout.lookup(spark, path, "id", value, 16))
        assert found == {(value, f"decision {value // 2}")} and files == 1 and read <= 4_000
    missing = layout.lookup(spark, path, "id", 4_445, 16)  # an odd number within the range of every file: only the filter knows
    assert scanned(missing) == (set(), 1, 0)
    named = f"file://{tmp_path}/named"
    layout.write_for_lookup(df.withColumn("id", F.concat(F.lit("k"), F.col("id").cast("string"))), named, "id", 4)
    assert rows(layout.lookup(spark, named, "id", "k8", 4)) == {("k8", "decision 4")} and rows(layout.lookup(spark, named, "id", "k9", 4)) == set()
