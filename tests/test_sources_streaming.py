"""Spool source, ZIP source, report sink and streaming ingestion on small files."""

import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import report as L
from tallyloom.sources import files, print_spool
from tallyloom.streaming import ingest


def spool(path, rows):
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE IF NOT EXISTS task (taskID TEXT, msg TEXT, time TEXT)")
        c.executemany("INSERT INTO task (taskID, msg, time) VALUES (?, ?, ?)", rows)


MESSAGE = '{"task": {"documents": [{"documentID": "d%d"}]}}'


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "print.db")
    spool(path, [(f"t{i}", MESSAGE % i, f"2024-01-0{1 + i % 5} 10:00:00") for i in range(12)] + [("t12", "no json", "garbage"), (None, None, "2023-01-01 00:00:00")])
    return path


def test_status_and_batch_scan(spark, database, tmp_path):
    print_spool.register(spark)
    assert print_spool.status(database)["state"] == "ready" and print_spool.status(str(tmp_path / "none.db"))["state"] == "missing"
    (tmp_path / "bad.db").write_bytes(b"no database" * 100)
    assert print_spool.status(str(tmp_path / "bad.db"))["state"] == "error"
    df = spark.read.format("print_spool").option("path", database).option("after", 3).option("partitionRows", 4).load()
    assert [r.rowid for r in df.orderBy("rowid").collect()] == list(range(4, 15)) and df.rdd.getNumPartitions() == 3


def windows(spark):
    raw = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-03 00:00:00", True), (2, "2024-01-02 00:00:00.600", None, False)], "window_id long, a string, b string, completed boolean")
    return raw.select("window_id", F.col("a").cast("timestamp_ntz").alias("started_at"), F.col("b").cast("timestamp_ntz").alias("ended_at"), "completed")


def run(spark, database, tmp_path):
    stream = spark.readStream.format("print_spool").option("path", database).option("partitionRows", 5).load()
    q = ingest.start(stream, windows(spark), f"file://{tmp_path}/target", f"file://{tmp_path}/checkpoint", "w", "c", "spool", available_now=True)
    assert q.awaitTermination(120)
    return spark.read.schema(ingest.TARGET).parquet(f"file://{tmp_path}/target").collect()


def test_stream_takes_each_event_once(spark, database, tmp_path):
    print_spool.register(spark)
    got = run(spark, database, tmp_path)
    assert len(got) == len({r.event_key for r in got}) == 13  # the row of 2023 is outside of every window
    kinds = {r.source_index.split(":")[1]: (r.kind, r.window_id) for r in got}
    assert kinds["1"] == ("late", 1) and kinds["2"] == ("inserted", 2) and kinds["13"][0] == "invalid_time"
    assert {r.document_id for r in got} >= {"d0", "d11", "t12"}
    spool(database, [("t14", MESSAGE % 14, "2024-01-05 00:00:00")])
    assert len(run(spark, database, tmp_path)) == 14


def test_replayed_batches_change_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("e", i, f"t{i}", MESSAGE % i, "2024-01-02 10:00:00", "window") for i in (1, 2, 2, 3)], print_spool.SCHEMA)
    batch = ingest.records(rows, "w", "c", "spool")
    target = f"file://{tmp_path}/target"
    assert ingest.store_batch(batch, 0, windows(spark), target) == {"inserted": 3, "duplicates": 0, "rejected": 0}
    assert ingest.store_batch(batch, 0, windows(spark), target) == {"inserted": 3, "duplicates": 0, "rejected": 0}
    assert ingest.store_batch(batch, 1, windows(spark), target) == {"inserted": 0, "duplicates": 3, "rejected": 0}
    assert spark.read.parquet(target).count() == 3


def test_uncovered_rows_fail_a_batch_as_a_whole(spark, tmp_path):
    rows = spark.createDataFrame([("e", i, f"t{i}", MESSAGE % i, f"202{3 + i % 2}-01-02 10:00:00", "window") for i in (1, 2, 3)], print_spool.SCHEMA)
    batch, target = ingest.records(rows, "w", "c", "spool"), f"file://{tmp_path}/target"
    with pytest.raises(ingest.UncoveredRows, match="1 rows of batch 0"):
        ingest.store_batch(batch, 0, windows(spark), target, uncovered="fail")
    assert list(tmp_path.glob("target*/batch_id=*")) == []
    earlier = spark.createDataFrame([(0, "2023-01-01 00:00:00", "2023-02-01 00:00:00", True)], "window_id long, a string, b string, completed boolean")
    wider = windows(spark).unionByName(earlier.select("window_id", F.col("a").cast("timestamp_ntz").alias("started_at"), F.col("b").cast("timestamp_ntz").alias("ended_at"), "completed"))
    assert ingest.store_batch(batch, 0, wider, target, uncovered="fail") == {"inserted": 3, "duplicates": 0, "rejected": 0}
    assert ingest.store_batch(batch, 1, windows(spark), target)["rejected"] == 1
    with pytest.raises(ValueError, match="unknown way"):
        ingest.store_batch(batch, 1, windows(spark), target, uncovered="ignore")


def test_what_a_batch_reads_does_not_grow_with_the_target(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "PART_ROWS", 40)
    monkeypatch.setattr(ingest, "PART_FOLDERS", 3)
    target = f"file://{tmp_path}/target"

    def batch(rowids):
        return ingest.records(spark.createDataFrame([("e", i, f"t{i}", MESSAGE % i, "2024-01-02 10:00:00", "window") for i in rowids], print_spool.SCHEMA), "w", "c", "spool")

    def read(rows, n):
        parts = [r.part for r in rows.select(ingest.key_part().alias("part")).distinct().collect()]
        files = ingest.known_keys(spark, target, parts, n).inputFiles()
        return len(files), sum((tmp_path / f.split(f"{tmp_path}/")[1]).stat().st_size for f in files)

    seen = []
    for n in range(12):
        rows = batch(range(10 * n - 2, 10 * n + 10))  # two rows of the batch before come again
        seen.append(read(rows, n))
        assert ingest.store_batch(rows, n, windows(spark), target) == {"inserted": 10 if n else 12, "duplicates": 2 if n else 0, "rejected": 0}
    assert max(files for files, _ in seen[6:]) <= max(files for files, _ in seen[:6]) <= 8 and 0 < max(size for _, size in seen[6:]) <= 1.1 * max(size for _, size in seen[:6])
    # rows of long ago are known still, through merged folders too, and the last batch may run again
    assert ingest.store_batch(batch(range(5, 115, 7)), 12, windows(spark), target)["inserted"] == 0
    assert ingest.store_batch(rows, 11, windows(spark), target)["inserted"] == 10
    assert spark.read.parquet(target).select("event_key").distinct().count() == spark.read.parquet(target).count() == 122
    # a target without an index gets one
    ingest._delete(spark, f"{target}-keys")
    assert ingest.store_batch(batch([3, 77, 1000]), 13, windows(spark), target) == {"inserted": 1, "duplicates": 2, "rejected": 0}


def test_rebuilt_database_starts_a_new_epoch(database, tmp_path):
    stream = print_spool.SpoolStream({"path": database})
    first = stream.latestOffset()
    other = str(tmp_path / "other.db")
    spool(other, [("x", "{}", "2024-01-02 10:00:00")] * 3)
    stream.path = other
    second = stream.latestOffset()
    assert second["epoch"] != first["epoch"] and (second["rowid"], second["ambiguous_upto"]) == (3, 14)
    (part,) = stream.partitions(first, second)
    assert [r[5] for r in stream.read(part)] == ["source_history_ambiguous"] * 3


def change(path, sql, *values):
    with sqlite3.connect(path) as c:
        c.execute(sql, values)


@pytest.mark.parametrize("sql", ["UPDATE task SET msg = 'other' WHERE rowid = 5", "DELETE FROM task WHERE rowid = 7", "UPDATE task SET rowid = 100 WHERE rowid = 3"])
def test_changed_history_starts_an_epoch(database, sql):
    stream = print_spool.SpoolStream({"path": database, "partitionRows": 5})
    first = stream.latestOffset()
    stream.partitions(stream.initialOffset(), first)
    spool(database, [("more", "{}", "2024-01-02 10:00:00")])
    second = stream.latestOffset()
    assert (second["epoch"], second["ambiguous_upto"], second["rowid"]) == (first["epoch"], 0, 15)
    assert [r[1] for p in stream.partitions(first, second) for r in stream.read(p)] == [15]
    change(database, sql)
    third = stream.latestOffset()
    assert third["epoch"] != second["epoch"] and third["ambiguous_upto"] == 15
    got = [r for p in stream.partitions(second, third) for r in stream.read(p)]
    assert {r[5] for r in got if r[1] <= 15} == {"source_history_ambiguous"} and {r[5] for r in got if r[1] > 15} <= {"window"}
    assert stream.latestOffset() == third  # the new history is as it should be from here on


def test_restarts_keep_epochs_and_ambiguous_rows(database, tmp_path):
    options = {"path": database, "state": str(tmp_path / "state.json")}
    stream = print_spool.SpoolStream(options)
    first = stream.latestOffset()
    stream.partitions(stream.initialOffset(), first)
    change(database, "DELETE FROM task")
    spool(database, [(f"n{i}", "{}", "2024-01-02 10:00:00") for i in range(4)])
    # stopped between the reset and the rows that follow: a new reader finds the same epoch, twice
    found = [print_spool.SpoolStream(options).latestOffset() for _ in range(2)]
    assert found[0] == found[1] and found[0]["epoch"] != first["epoch"] and (found[0]["rowid"], found[0]["ambiguous_upto"]) == (4, 14)
    again = print_spool.SpoolStream(options)
    assert [r[5] for p in again.partitions(first, found[0]) for r in again.read(p)] == ["source_history_ambiguous"] * 4
    spool(database, [(f"m{i}", "{}", "2024-01-02 10:00:00") for i in range(12)])
    later = print_spool.SpoolStream(options)
    end = later.latestOffset()
    assert end["epoch"] == found[0]["epoch"] and end["ambiguous_upto"] == 14
    assert [r[5] for p in later.partitions(found[0], end) for r in later.read(p)] == ["source_history_ambiguous"] * 10 + ["window"] * 2


def test_audit_at_the_start_only(database):
    stream = print_spool.SpoolStream({"path": database, "audit": "start"})
    first = stream.latestOffset()
    spool(database, [("more", "{}", "2024-01-02 10:00:00")])
    second = stream.latestOffset()
    fresh = print_spool.SpoolStream({"path": database}).latestOffset()
    assert second["chain"] == fresh["chain"] and second["epoch"] == first["epoch"]
    change(database, "DELETE FROM task WHERE rowid = 4")  # one row less before the cursor is seen without an audit
    assert stream.latestOffset()["epoch"] != first["epoch"]


def test_zip_images(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/SKU图/SKU图_1_black.jpg", b"one")
        z.writestr("x/SKU图/deep/SKU图_2-black.PNG", b"two")
        z.writestr("x/SKU图/white.webp", b"three")
        z.writestr("x/other/red.jpg", b"four")
        z.writestr("x/SKU图/readme.txt", b"five")
    got = {r.sku_name: bytes(r.content) for r in files.sku_images(spark, f"file://{tmp_path}/a.zip").collect()}
    assert got == {"black": b"one", "white": b"three"}


def test_report_sink(spark, tmp_path):
    lines = spark.createDataFrame([("S", "=P", "black", "42", 3, "", "t"), ("T", "Q", "-", "9", 1, "r", "")], "stall_name string, product_name string, spec string, size_text string, quantity long, remark string, image_match_text string")
    layout = {"columns": [{"key": "product_name", "label": "name"}, {"key": "sku_image", "visible": False}]}
    files.write_report(lines, f"file://{tmp_path}/one", layout, "merged_sheet")
    got = spark.read.option("header", True).csv(f"file://{tmp_path}/one").orderBy("name").collect()
    assert [r.name for r in got] == ["'=P", "Q"] and len(got[0]) == len(L.COLUMNS) - 1
    files.write_report(lines, f"file://{tmp_path}/two", layout)
    assert {r.stall for r in spark.read.option("header", True).csv(f"file://{tmp_path}/two").collect()} == {"S", "T"}
