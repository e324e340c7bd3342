"""Streaming ingestion of captured records: event identity, capture windows, and a sink that takes each event once.

A micro-batch is keyed, classified against the windows and written where its keys are not in the target yet. Keys are kept beside
the target, not in state, as replays may come at any time: in parts by source and range of rows, of which a batch reads those that
its own rows fall into, so that what it reads is bounded by the range's size and not by the target's. A batch that runs again gives the same target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.reading import document_id
from tallyloom.operators.records import classify, event_key, first_of_each, held_by

TARGET = "event_key string, workspace string, collector string, source_component string, source_index string, document_id string, raw_payload string, captured_at timestamp_ntz, window_id long, kind string, batch_id long"
REJECTED = ("rejected",)
#: A payload's characters, at most; longer ones are quarantined with their kind.
MOST_PAYLOAD = 2_000_000
#: Source rows in a part of the key index, and folders of batches in a part, at most, before they are merged into one.
PART_ROWS, PART_FOLDERS = 100_000, 32
KEYS = "event_key string, stored_by long, part string, run long"


def records(rows: DataFrame, workspace: str, collector: str, component: str) -> DataFrame:
    """Spool rows (source_epoch, rowid, task_id, msg, time, capture_assignment) as records with their event key."""
    index = F.concat_ws(":", F.coalesce("source_epoch", F.lit("")), F.col("rowid").cast("string"))
    out = rows.select(
        F.lit(workspace).alias("workspace"),
        F.lit(collector).alias("collector"),
        F.lit(component).alias("source_component"),
        index.alias("source_index"),
        document_id(F.when(F.col("msg").rlike(r"^\s*\{"), F.col("msg")), F.col("task_id"), index).alias("document_id"),
        F.col("msg").alias("raw_payload"),
        F.try_to_timestamp("time", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("captured_at"),
        "capture_assignment",
    )
    return out.withColumn("event_key", event_key(F.col("workspace"), F.col("collector"), F.col("source_component"), F.col("source_index")))


def assigned(batch: DataFrame, windows: DataFrame) -> DataFrame:
    """batch with window_id and kind: the newest window that holds the time; unknown times go to the newest window and are quarantined."""
    w = windows.select("window_id", "started_at", "ended_at", "completed")
    timed = held_by(batch.where(F.col("captured_at").isNotNull()).select("event_key", "captured_at"), w, "captured_at", F.date_trunc("second", "started_at"))
    held = timed.groupBy("event_key").agg(F.max(F.struct("window_id", "completed")).alias("w"))
    newest = w.agg(F.max(F.struct("window_id", "completed")).alias("w"))  # one row
    held = held.unionByName(batch.where(F.col("captured_at").isNull()).select("event_key").distinct().join(F.broadcast(newest), how="cross"))
    kind = classify(F.lit(None).cast("timestamp_ntz"), F.col("captured_at").isNotNull(), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"), F.coalesce(F.col("w.completed"), F.lit(False)))
    out = batch.join(held, "event_key").withColumn("window_id", F.col("w.window_id"))
    ambiguous = F.col("capture_assignment") == "source_history_ambiguous"
    kind = F.when(F.length("raw_payload") > MOST_PAYLOAD, "too_long").when(ambiguous, "ambiguous").when(F.col("window_id").isNull(), "rejected").otherwise(kind)
    return out.withColumn("kind", kind).drop("w", "capture_assignment")


def key_part():
    """The part of the key index that an event belongs to, of nothing but what its key is made of: source and epoch, and the row's range; other indexes go by their hash."""
    epoch, row = (F.regexp_extract(F.coalesce("source_index", F.lit("")), r"^(.*):([0-9]{1,18})$", k) for k in (1, 2))
    source = F.md5(F.to_json(F.array("workspace", "collector", "source_component", epoch)))
    block = F.when(row != "", F.floor(row.cast("long") / PART_ROWS).cast("string")).otherwise(F.concat(F.lit("x"), F.substring(F.md5("event_key"), 1, 2)))
    return F.concat_ws("-", F.substring(source, 1, 16), block)


def known_keys(spark: SparkSession, target: str, parts: list[str], batch_id: int) -> DataFrame:
    """The keys that other batches stored in some parts of the index."""
    folders = [f"{target}-keys/part={p}" for p in parts]
    folders = [f for f in folders if _exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], KEYS)
    return spark.read.schema(KEYS).option("basePath", f"{target}-keys").parquet(*folders).where(F.col("stored_by") != batch_id)


def _store_keys(rows: DataFrame, target: str, parts: list[str], batch_id: int) -> None:
    """Puts a batch's keys into the index in place of those that an earlier run of it left there, then merges parts of too many batches."""
    spark = rows.sparkSession
    for p in parts:
        _delete(spark, f"{target}-keys/part={p}/run={batch_id}")
    number = F.lit(batch_id).cast("long")
    rows.select("event_key", number.alias("stored_by"), key_part().alias("part"), number.alias("run")).repartition("part").write.mode("append").partitionBy("part", "run").parquet(f"{target}-keys")
    for p in parts:
        merge_keys(spark, target, p, batch_id)


def merge_keys(spark: SparkSession, target: str, part: str, batch_id: int) -> None:
    """Merges a part's folders of earlier batches, when there are over PART_FOLDERS. The merged folder is in place before the others go: a run that stops between leaves keys twice, never none."""
    top = f"{target}-keys/part={part}"
    old = [n for n in _names(spark, top) if n.startswith("run=") and n != f"run={batch_id}"]
    if len(old) <= PART_FOLDERS:
        return
    # batches' numbers are 0 or more; merged folders count down from -1
    merged = min(0, *(int(n.split("=")[1]) for n in old)) - 1
    spark.read.schema("event_key string, stored_by long").parquet(*[f"{top}/{n}" for n in old]).distinct().coalesce(1).write.mode("overwrite").parquet(f"{top}/.merging")
    source, place = (spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{n}") for n in (".merging", f"run={merged}"))
    if not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, place):
        raise OSError(f"{source} could not be renamed")
    for n in old:
        _delete(spark, f"{top}/{n}")


def index_keys(spark: SparkSession, target: str) -> None:
    """Makes the key index of a target that has none, from all its rows."""
    if _exists(spark, f"{target}-keys") or not _exists(spark, target):
        return
    rows = spark.read.schema(TARGET).parquet(target).select("event_key", F.col("batch_id").alias("stored_by"), key_part().alias("part"), F.lit(-1).cast("long").alias("run"))
    rows.repartition("part").write.mode("overwrite").partitionBy("part", "run").parquet(f"{target}-keys-new")
    new, place = (spark._jvm.org.apache.hadoop.fs.Path(f"{target}-keys{x}") for x in ("-new", ""))
    if not new.getFileSystem(spark._jsc.hadoopConfiguration()).rename(new, place):
        raise OSError(f"{new} could not be renamed")


class UncoveredRows(Exception):
    """A batch has rows that no capture window holds."""


def store_batch(batch: DataFrame, batch_id: int, windows: DataFrame, target: str, uncovered: str = "reject") -> dict:
    """Adds the batch's new events to the target (Parquet, a folder for each batch); returns the counts of what became of its rows.

    Rows outside of every window are left out, or, if uncovered is "fail", fail the whole batch before any of it is stored: the stream
    stops where it is, nothing is acknowledged, and the same batch comes again once windows cover it."""
    if uncovered not in ("reject", "fail"):
        raise ValueError(f"unknown way with uncovered rows: {uncovered!r}")
    spark = batch.sparkSession
    once = first_of_each(batch, "event_key", ["source_index"])
    # the judged batch is written first, beside the target: the stream's rows are read once
    staged = f"{target}-staged/batch_id={batch_id}"
    assigned(once, windows).write.mode("overwrite").parquet(staged)
    judged = spark.read.parquet(staged)
    if uncovered == "fail":
        outside = judged.where(F.col("kind").isin(*REJECTED)).agg(F.count("*").alias("n"), F.min("source_index").alias("first")).first()
        if outside.n:
            _delete(spark, staged)
            raise UncoveredRows(f"{outside.n} rows of batch {batch_id} are in no window, {outside.first} among them")
    index_keys(spark, target)
    parts = [r.part for r in judged.select(key_part().alias("part")).distinct().collect()]  # one for each source and PART_ROWS rows of a batch
    # the batch's own folders are written anew when it runs again
    new = judged.where(~F.col("kind").isin(*REJECTED)).join(known_keys(spark, target, parts, batch_id).select("event_key"), "event_key", "left_anti")
    columns = [c.split(" ")[0] for c in TARGET.split(", ") if not c.startswith("batch_id ")]
    new.select(*columns).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
    _store_keys(spark.read.parquet(f"{target}/batch_id={batch_id}"), target, parts, batch_id)
    counts = {r.kind: r["count"] for r in judged.groupBy("kind").count().collect()}  # a row for each kind
    inserted = spark.read.parquet(f"{target}/batch_id={batch_id}").count()
    _delete(spark, staged)
    return {"inserted": inserted, "duplicates": sum(counts.values()) - counts.get("rejected", 0) - inserted, "rejected": counts.get("rejected", 0)}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def start(stream: DataFrame, windows: DataFrame, target: str, checkpoint: str, workspace: str, collector: str, component: str, available_now: bool = False, uncovered: str = "reject") -> StreamingQuery:
    """Runs the ingestion of a stream of spool rows."""
    writer = records(stream, workspace, collector, component).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, batch_id: store_batch(batch, batch_id, windows, target, uncovered) and None)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="3 seconds")).start()
