"""Purges over three levels: all of a window and nothing else, again after they broke off."""

import os

from pyspark.sql import functions as F

from tallyloom.operators import retention as Y


def tables(spark, top):
    tasks = spark.range(20).select(F.col("id").alias("task"), (F.col("id") % 4).alias("month"))
    records = spark.range(100).select(F.col("id").alias("record"), (F.col("id") % 20).alias("task"), (F.col("id") % 20 % 4).alias("month"))
    rows = spark.range(300).select(F.col("id").alias("row"), (F.col("id") % 100).alias("record"))
    tasks.write.partitionBy("month").parquet(f"{top}/tasks")
    records.write.partitionBy("month").parquet(f"{top}/records")
    rows.write.parquet(f"{top}/rows")
    return [("tasks", f"{top}/tasks", "task"), ("records", f"{top}/records", "record"), ("rows", f"{top}/rows", "row")]


def read(spark, path, key):
    return sorted(r[0] for r in spark.read.parquet(path).select(key).collect())


def test_purge_takes_all_levels_and_nothing_else(spark, tmp_path):
    top = f"file://{tmp_path}"
    paths = tables(spark, top)
    load = {n: spark.read.parquet(p) for n, p, _ in paths}
    levels = [Y.Level("tasks", load["tasks"], "task"), Y.Level("records", load["records"], "record", "tasks", "task"), Y.Level("rows", load["rows"], "row", "records", "record")]
    stones = Y.tombstones(levels, (F.col("month") == 1) & (F.col("task") < 10), F.col("month").cast("string"))
    stones.write.parquet(f"{top}/marked")
    assert sorted(tuple(r) for r in Y.purge_counts(spark.read.parquet(f"{top}/marked")).collect()) == [("records", "1", 15), ("rows", "1", 45), ("tasks", "1", 3)]
    before = {n: read(spark, p, k) for n, p, k in paths}
    untouched = {d: os.listdir(tmp_path / "records" / d) for d in ("month=0", "month=2", "month=3")}
    assert Y.purge(spark, paths, f"{top}/marked") == {"rows": 45, "records": 15, "tasks": 3}
    gone = {1, 5, 9}
    want = {"tasks": [t for t in before["tasks"] if t not in gone], "records": [r for r in before["records"] if r % 20 not in gone], "rows": [x for x in before["rows"] if x % 100 % 20 not in gone]}
    assert {n: read(spark, p, k) for n, p, k in paths} == want
    assert {d: os.listdir(tmp_path / "records" / d) for d in untouched} == untouched  # folders without such rows stay as they are
    assert Y.purge(spark, paths, f"{top}/marked") == {"rows": 0, "records": 0, "tasks": 0}
    # broken off between the two renames, and while the new folder was written
    os.rename(tmp_path / "records/month=1", tmp_path / "records/_purging-month=1")
    os.makedirs(tmp_path / "records/_purged-month=1")
    os.makedirs(tmp_path / "_purging-rows")
    os.makedirs(tmp_path / "_purging-others")
    assert Y.purge(spark, paths, f"{top}/marked") == {"rows": 0, "records": 0, "tasks": 0}
    assert {n: read(spark, p, k) for n, p, k in paths} == want
    assert os.path.exists(tmp_path / "_purging-others") and not os.path.exists(tmp_path / "_purging-rows") and sorted(d for d in os.listdir(tmp_path / "records") if d.startswith("_p")) == []


def test_nothing_expired(spark, tmp_path):
    top = f"file://{tmp_path}"
    paths = tables(spark, top)
    levels = [Y.Level("tasks", spark.read.parquet(paths[0][1]), "task")]
    Y.tombstones(levels, F.lit(False), F.lit("x")).write.parquet(f"{top}/marked")
    assert Y.purge(spark, paths[:1], f"{top}/marked") == {"tasks": 0} and len(read(spark, paths[0][1], "task")) == 20
