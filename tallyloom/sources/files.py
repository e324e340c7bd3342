"""ZIP and rule-pack sources, and the report sinks."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import safe_cell, sku_name_from_file
from tallyloom.operators.report import apply_layout

IMAGE = r"(?i)(?:^|[/\\])SKU图[/\\].+\.(?:jpg|jpeg|png|webp)$"


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for place, info in enumerate(z.infolist()):
                    if not info.is_dir():
                        yield pd.DataFrame({"archive": [path], "place": [place], "name": [info.filename], "content": [z.read(info)]})


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file in the archives at `path`: archive, place, name and content. An archive is one task's work, an entry one row."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_unzip, "archive string, place int, name string, content binary")


def sku_images(spark: SparkSession, path: str) -> DataFrame:
    """The images below SKU图 of the archives, the first for each SKU name, with the content's hash."""
    found = zip_entries(spark, path).where(F.col("name").rlike(IMAGE)).withColumn("sku_name", sku_name_from_file(F.col("name")))
    first = found.groupBy("sku_name").agg(F.min_by(F.struct("name", "content"), F.struct("archive", "place")).alias("f"))
    return first.select("sku_name", "f.name", "f.content", F.sha2("f.content", 256).alias("content_hash"))


def read_rule_packs(spark: SparkSession, path: str) -> list[dict]:
    """Rule packs (JSON documents, one to a file); their number is small by nature."""
    return [json.loads(r.value) for r in spark.read.text(path, wholetext=True).collect()]


def write_report(lines: DataFrame, path: str, layout: dict | str | None = None, mode: str = "stall_sheet") -> None:
    """Report lines as CSV with the layout's labels: merged_sheet is one table, stall_sheet and stall_workbooks have a folder for each stall.

    Text cells that a spreadsheet would take for formulas are guarded."""
    if mode not in ("merged_sheet", "stall_sheet", "stall_workbooks"):
        raise ValueError(f"unknown mode {mode!r}")
    def guarded(df: DataFrame) -> DataFrame:
        return df.select(*[safe_cell(F.col(f"`{c}`")).alias(c) if t == "string" and c != "stall" else F.col(f"`{c}`") for c, t in df.dtypes])

    if mode == "merged_sheet":
        guarded(apply_layout(lines, layout)).write.mode("overwrite").option("header", True).csv(path)
    else:
        by_stall = apply_layout(lines.withColumn("stall", F.col("stall_name")), layout, keep=["stall"])
        guarded(by_stall).write.mode("overwrite").option("header", True).partitionBy("stall").csv(path)
