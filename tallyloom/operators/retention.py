"""Purges: what is past its retention gets tombstones, at every level below it as well, and tables are rewritten without these rows.

Tombstones are a table of their own, by period, so that a purge can be looked at before it takes effect and run again after it broke
off: rows that are gone already have tombstones and nothing else, and rows that came later have none.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Level(NamedTuple):
    """A table of a cascade: its rows go with the rows of `parent` that `parent_key` names. The first level has no parent."""

    name: str
    rows: DataFrame
    key: str
    parent: str | None = None
    parent_key: str | None = None


def tombstones(levels: list[Level], expired: Column, period: Column) -> DataFrame:
    """(level, period, root, key): the rows of the first level that are expired, and all rows of the other levels below them.

    Levels come parents first. root is the expired row's key, key the row's own, both as text; only keys are joined."""
    first, *rest = levels
    found = {first.name: first.rows.where(expired).select(period.alias("period"), F.col(first.key).cast("string").alias("root"), F.col(first.key).cast("string").alias("key"))}
    for level in rest:
        above = found[level.parent].select("period", "root", F.col("key").alias("__parent"))
        own = level.rows.select(F.col(level.parent_key).cast("string").alias("__parent"), F.col(level.key).cast("string").alias("key"))
        found[level.name] = own.join(above, "__parent").select("period", "root", "key")
    out = None
    for name, rows in found.items():
        part = rows.select(F.lit(name).alias("level"), "period", "root", "key")
        out = part if out is None else out.unionByName(part)
    return out


def purge_counts(stones: DataFrame) -> DataFrame:
    """How many rows of each level a purge takes in each period."""
    return stones.groupBy("level", "period").agg(F.count("*").alias("n"))


def purge(spark: SparkSession, tables: list[tuple[str, str, str]], marked: str) -> dict[str, int]:
    """Takes the rows with tombstones out of tables (level, path, key), children first; returns the rows taken from each.

    Tombstones are read from the table `marked`. Only the tables' partition folders that hold such rows are written anew: each into a
    hidden folder beside it, which then takes its place by two renames. A run that breaks off is finished by the next one: a hidden
    folder is whole if its writer has said so, and counts only if the old one is out of the way."""
    stones = spark.read.parquet(marked)
    taken = {}
    for name, path, key in reversed(tables):
        _finish(spark, path)
        gone = stones.where(F.col("level") == name).select(F.col("key").alias("__key")).distinct()
        rows = spark.read.parquet(path).withColumn("__folder", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))
        hit = rows.join(gone, F.col(key).cast("string") == F.col("__key"), "left_semi").groupBy("__folder").count().collect()  # a row for each folder
        taken[name] = sum(r["count"] for r in hit)
        for r in hit:
            folder = r["__folder"]
            new, _ = _beside(folder)
            kept = spark.read.parquet(folder).join(gone, F.col(key).cast("string") == F.col("__key"), "left_anti")
            kept.write.mode("overwrite").parquet(new)
            _swap(spark, folder)
    return taken


def _beside(folder: str) -> tuple[str, str]:
    """The hidden folders for the new and the old content of a folder; names with an underscore are in no table."""
    top, _, name = folder.rstrip("/").rpartition("/")
    return f"{top}/_purging-{name}", f"{top}/_purged-{name}"


def _paths(spark: SparkSession, *names: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = [path(n) for n in names]
    return found[0].getFileSystem(spark._jsc.hadoopConfiguration()), *found


def _swap(spark: SparkSession, folder: str) -> None:
    fs, at, new, old = _paths(spark, folder, *_beside(folder))
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)


def _finish(spark: SparkSession, path: str) -> None:
    """Puts right what an earlier run left below a table's folder, or beside it."""
    fs, top = _paths(spark, path)
    left, folders = [path.rstrip("/").rpartition("/")[0]], [path]
    while folders:
        here = folders.pop()
        for f in fs.listStatus(_paths(spark, here)[1]) if fs.exists(_paths(spark, here)[1]) else []:
            name = f.getPath().getName()
            if f.isDirectory() and "=" in name and not name.startswith("_"):
                folders.append(f.getPath().toString())
        left.append(here)
    for here in dict.fromkeys(left):
        inside = {f.getPath().getName() for f in fs.listStatus(_paths(spark, here)[1])} if fs.exists(_paths(spark, here)[1]) else set()
        for name in sorted({n.split("-", 1)[1] for n in inside if n.startswith(("_purging-", "_purged-"))}):
            if here == left[0] and name != path.rstrip("/").rpartition("/")[2]:
                continue  # another table's
            folder = f"{here}/{name}"
            _, at, new, old = _paths(spark, folder, *_beside(folder))
            if not fs.exists(at):  # between the renames: the new content is whole, as the old one was only moved after that
                _swap(spark, folder)
            fs.delete(new, True)
            fs.delete(old, True)
