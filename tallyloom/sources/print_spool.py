"""Python data source for print-spool databases: SQLite files with a table task(rowid, taskID, msg, time).

Batch reads scan rows after a cursor in key order, a range of keys for each partition. Streams keep the cursor as the
offset, so that Spark's checkpoint is the watermark. A database that was rebuilt, i.e. has fewer rows than the cursor or
another first row, starts a new epoch at 0; rows up to the old cursor are then marked as ambiguous history.
The path must be readable by every executor.
"""

from __future__ import annotations

import hashlib
import json
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_epoch string, rowid long, task_id string, msg string, time string, capture_assignment string"
#: Rows of one partition, if the options do not say.
PARTITION_ROWS = 5_000


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def row_hash(row: tuple) -> str:
    return hashlib.sha256("\0".join("" if v is None else str(v) for v in row).encode()).hexdigest()


def status(path: str) -> dict:
    """state (missing, unsupported, error or ready), the number of rows, the largest key and the first row's hash."""
    try:
        with _connect(path) as c:
            if not c.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = 'task'").fetchone():
                return {"state": "unsupported", "rows": 0, "max_rowid": 0, "first": ""}
            n, top = c.execute("SELECT count(*), coalesce(max(rowid), 0) FROM task").fetchone()
            first = c.execute("SELECT rowid, taskID, msg, time FROM task ORDER BY rowid LIMIT 1").fetchone()
            return {"state": "ready", "rows": n, "max_rowid": top, "first": row_hash(first) if first else ""}
    except sqlite3.OperationalError:
        return {"state": "missing", "rows": 0, "max_rowid": 0, "first": ""}
    except sqlite3.DatabaseError:
        return {"state": "error", "rows": 0, "max_rowid": 0, "first": ""}


class KeyRange(InputPartition):
    def __init__(self, path: str, after: int, upto: int, epoch: str, ambiguous_upto: int) -> None:
        self.path, self.after, self.upto, self.epoch, self.ambiguous_upto = path, after, upto, epoch, ambiguous_upto


def read_range(part: KeyRange) -> Iterator[tuple]:
    with _connect(part.path) as c:
        for rowid, task, msg, time in c.execute("SELECT rowid, taskID, msg, time FROM task WHERE rowid > ? AND rowid <= ? ORDER BY rowid", (part.after, part.upto)):
            yield (part.epoch, rowid, task, msg, time, "source_history_ambiguous" if rowid <= part.ambiguous_upto else "window")


def ranges(path: str, after: int, upto: int, epoch: str, size: int, ambiguous_upto: int = 0) -> list[KeyRange]:
    return [KeyRange(path, a, min(a + size, upto), epoch, ambiguous_upto) for a in range(after, upto, size)]


class SpoolReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.after, self.size = options["path"], int(options.get("after", 0)), int(options.get("partitionRows", PARTITION_ROWS))

    def partitions(self) -> list[KeyRange]:
        s = status(self.path)
        return ranges(self.path, self.after, s["max_rowid"], s["first"][:12], self.size)

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        return read_range(partition)


def chained(path: str, prefix: str, after: int, upto: int, mark: int = 0) -> tuple[str, str]:
    """The chain of the hashes of all rows behind `after` up to `upto`, carried on from `prefix`; and what it was at `mark`.

    Each link is the hash of the chain before and of a row with its key, so that a chain can be carried on without the rows that made it."""
    at_mark = prefix
    with _connect(path) as c:
        for row in c.execute("SELECT rowid, taskID, msg, time FROM task WHERE rowid > ? AND rowid <= ? ORDER BY rowid", (after, upto)):
            prefix = hashlib.sha256(f"{prefix}{row_hash(row)}".encode()).hexdigest()
            if row[0] <= mark:
                at_mark = prefix
    return prefix, at_mark


class SpoolStream(DataSourceStreamReader):
    """Offsets hold the cursor, the epoch, the chain of all rows up to the cursor, and up to which row the epoch's history is ambiguous.

    Before a batch the rows up to the cursor are audited: if their chain is no longer what it was (rows changed, went or came in the
    middle, or the database was built anew), a new epoch starts, whose rows up to the old cursor are ambiguous. An epoch's name is made of
    the one before and of the first row, so that it stays the same if the same is found again after a restart.
    Spark does not tell a restarted reader where it stands; the option `state` names a file that does. Option audit="start" audits
    when the reader starts, and later only if the first row, the last row or the number of rows before the cursor changed."""

    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("partitionRows", PARTITION_ROWS))
        self.state, self.always, self.audited = options.get("state"), options.get("audit", "always") == "always", False
        self.at = self._restored() or self.initialOffset()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rowid": 0, "epoch": "", "chain": "", "rows": 0, "last": "", "ambiguous_upto": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        s = status(self.path)
        if s["state"] == "ready":
            self.at = self._next(self.at, s)
            self.audited = True
        return self.at

    def _next(self, at: dict, s: dict) -> dict:
        top, first = s["max_rowid"], s["first"]
        now = {"rowid": top, "rows": s["rows"], "last": self._last(top)}
        if not at["epoch"]:
            return now | {"epoch": first[:12], "chain": chained(self.path, "", 0, top)[0], "ambiguous_upto": 0}
        if top >= at["rowid"] and not self.always and self.audited and self._looks_same(at):
            return now | {"epoch": at["epoch"], "chain": chained(self.path, at["chain"], at["rowid"], top)[0], "ambiguous_upto": at["ambiguous_upto"]}
        chain, before = chained(self.path, "", 0, top, at["rowid"])
        if top >= at["rowid"] and before == at["chain"]:
            return now | {"epoch": at["epoch"], "chain": chain, "ambiguous_upto": at["ambiguous_upto"]}
        epoch = hashlib.sha256(f"{at['epoch']}:{first}".encode()).hexdigest()[:12]
        return now | {"epoch": epoch, "chain": chain, "ambiguous_upto": at["rowid"]}

    def _last(self, rowid: int) -> str:
        with _connect(self.path) as c:
            row = c.execute("SELECT rowid, taskID, msg, time FROM task WHERE rowid = ?", (rowid,)).fetchone()
        return row_hash(row) if row else ""

    def _looks_same(self, at: dict) -> bool:
        with _connect(self.path) as c:
            (n,) = c.execute("SELECT count(*) FROM task WHERE rowid <= ?", (at["rowid"],)).fetchone()
        return n == at["rows"] and self._last(at["rowid"]) == at["last"]

    def _restored(self) -> dict | None:
        if not self.state:
            return None
        try:
            with open(self.state) as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def _keep(self, at: dict) -> None:
        if self.state:
            with open(f"{self.state}.new", "w") as f:
                json.dump(at, f)
            os.replace(f"{self.state}.new", self.state)

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        self.at = end  # planned offsets are in Spark's log: a restart plans them again, or goes on from them
        self._keep(end)
        if start["epoch"] not in ("", end["epoch"]) or end["rowid"] < start["rowid"]:
            return ranges(self.path, 0, end["rowid"], end["epoch"], self.size, max(end["ambiguous_upto"], start["rowid"]))
        return ranges(self.path, start["rowid"], end["rowid"], end["epoch"], self.size, end["ambiguous_upto"])

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        return read_range(partition)

    def commit(self, end: dict) -> None:
        return None


class PrintSpool(DataSource):
    @classmethod
    def name(cls) -> str:
        return "print_spool"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SpoolReader:
        return SpoolReader(self.options)

    def streamReader(self, schema) -> SpoolStream:  # noqa: N802
        return SpoolStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PrintSpool)
