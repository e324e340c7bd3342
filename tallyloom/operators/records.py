"""Scans, numbering, capture windows, event identity, precedence and comparison of captured records."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- scans ----


def active(rows: DataFrame, deleted: Column | None = None, archived_at: Column | None = None, workspaces: list | None = None, workspace: Column | None = None) -> DataFrame:
    """Rows that are neither deleted nor archived, of the allowed workspaces."""
    keep = F.lit(True)
    if deleted is not None:
        keep = keep & ~F.coalesce(deleted, F.lit(False))
    if archived_at is not None:
        keep = keep & archived_at.isNull()
    if workspaces is not None:
        keep = keep & workspace.isin(list(workspaces))
    return rows.where(keep)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def keyword_search(rows: DataFrame, column: str, keyword: str) -> DataFrame:
    """ILIKE '%keyword%'; % and _ in the keyword keep their meaning."""
    return rows.where(F.col(column).ilike(f"%{keyword}%"))


def before_cutoff(rows: DataFrame, cutoff: Column, *times: Column) -> DataFrame:
    """Rows whose first known time is not after the cutoff; rows without a time stay out."""
    return rows.where(F.coalesce(*times) <= cutoff)


def capture_summary(rows: DataFrame, collecting: Column, archived: Column) -> DataFrame:
    return rows.agg(F.count_if(~archived).alias("active"), F.count_if(archived).alias("archived"), F.count_if(collecting & ~archived).alias("collecting"))


# ---- numbering ----


def number_parents(documents: DataFrame, task: str, order: list[str], out: str = "parent_sequence") -> DataFrame:
    """1-based numbers over the documents of each task."""
    return documents.withColumn(out, F.row_number().over(Window.partitionBy(task).orderBy(*order)).cast("bigint"))


def running_sequences(records: DataFrame, task: str, order: list[str], n_docs: str, explicit: str, out: str = "first_sequence") -> DataFrame:
    """The number of each record's first document: the sum of document counts before it, counted anew from an explicit number on."""
    w = Window.partitionBy(task).orderBy(*order)
    reset = F.sum(F.when(F.col(explicit).isNotNull(), 1).otherwise(0)).over(w)
    numbered = records.withColumn("__reset", reset)
    g = Window.partitionBy(task, "__reset").orderBy(*order)
    base = F.first(explicit).over(g)
    before = F.coalesce(F.sum(n_docs).over(g.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.withColumn(out, (F.coalesce(base, F.lit(1)) + before).cast("bigint")).drop("__reset")


def nth_per_class(spans: DataFrame, parent: list[str], cls: str, order: list[str], value: str, picks: dict[str, tuple[str, int]]) -> DataFrame:
    """A fixed row template: for each name, the n-th (from 0) span of a class; a missing one is an empty text."""
    most = max(n for _, n in picks.values()) + 1
    w = Window.partitionBy(*parent, cls).orderBy(*order)
    few = spans.withColumn("__n", F.row_number().over(w) - 1).where(F.col("__n") < most)
    return few.groupBy(*parent).agg(*[F.coalesce(F.max(F.when((F.col(cls) == c) & (F.col("__n") == n), F.col(value))), F.lit("")).alias(name) for name, (c, n) in picks.items()])


# ---- capture windows and events ----


def inside_window(time: Column, start: Column, end: Column) -> Column:
    """Unknown times pass; others must lie between the start's second and the end."""
    return time.isNull() | (F.coalesce(time >= F.date_trunc("second", start), F.lit(True)) & F.coalesce(time <= end, F.lit(True)))


def held_by(events: DataFrame, windows: DataFrame, time: str, start: Column | None = None) -> DataFrame:
    """events joined with the windows (window_id, started_at, ended_at and others) that hold their time, from `start` (started_at, if None) on;
    events in none stay, with nulls. An equi-join on days, then verified; windows without end reach to the newest event's day."""
    start = F.col("started_at") if start is None else start
    day = lambda c: F.date_trunc("day", c).cast("date")
    last = events.agg(F.max(time).alias("__last"))
    open_to = F.greatest(F.coalesce(day(F.col("ended_at")), day(F.col("__last"))), day(start))
    by_day = windows.join(F.broadcast(last), how="cross").withColumn("__to", F.least(open_to, F.greatest(day(F.col("__last")), day(start)))).withColumn("__day", F.explode(F.sequence(day(start), F.col("__to")))).drop("__last", "__to")  # `last` is one row
    inside = (F.col("__at") == F.col("__day")) & (F.col(time) >= start) & F.coalesce(F.col(time) <= F.col("ended_at"), F.lit(True))
    return events.withColumn("__at", day(F.col(time))).join(by_day, inside, "left").drop("__at", "__day")


def assign_windows(events: DataFrame, windows: DataFrame, time: str, key: list[str]) -> DataFrame:
    """events with window_id: of the windows (window_id, started_at, ended_at) that hold its time, the newest. Times that no window holds have none."""
    return held_by(events.select(*key, time), windows, time).groupBy(*key).agg(F.max("window_id").alias("window_id"))


def event_key(workspace: Column, collector: Column, component: Column, index: Column) -> Column:
    """The identity of an event: a hash of its source only, never of its content."""
    zero = F.lit("\0")
    return F.sha2(F.concat(workspace.cast("string"), zero, collector.cast("string"), zero, component.cast("string"), zero, index.cast("string")), 256)


def first_of_each(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One event for each key, the first by order; partial aggregation drops replays before the shuffle."""
    whole = F.struct(*order, *[c for c in events.columns if c not in (*order, key)])
    return events.groupBy(key).agg(F.min(whole).alias("e")).select(key, "e.*")


def classify(time: Column, valid: Column, start: Column, end: Column, completed: Column) -> Column:
    """invalid_time, rejected, late (a completed window takes what lies inside it) or inserted."""
    inside = inside_window(time, start, end)
    return F.when(~valid, "invalid_time").when(~inside, "rejected").when(completed, "late").otherwise("inserted")


def pending_profile(rows: DataFrame, source: str, rowid: str, time: str, cursors: DataFrame) -> DataFrame:
    """For each source: rows beyond its cursor, and their earliest and latest time."""
    got = rows.groupBy(source).agg(F.max(rowid).alias("max_rowid"))
    later = rows.join(cursors, source).where(F.col(rowid) > F.col("cursor")).groupBy(source).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    return cursors.join(got, source, "left").join(later, source, "left").select(source, F.greatest(F.coalesce("max_rowid", F.lit(0)) - F.col("cursor"), F.lit(0)).cast("bigint").alias("pending"), "first_time", "last_time")


def hash_chain(rows: DataFrame, group: str, order: list[str], content: Column, most: int | None = None) -> DataFrame:
    """For each group, n and h = sha256(h, place, sha256(content)) over its n rows in order; a null content makes its group's chain null, as do
    more than `most` rows where a bound is given.

    Rows meet as (group, order, 32 bytes), sorted by Spark, and a task folds them with one digest of state, so groups can be of any length."""
    hashed = rows.select(F.col(group).alias("g"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.unhex(F.sha2(content, 256)).alias("h"))
    dealt = hashed.repartition("g").sortWithinPartitions("g", *[f"o{i}" for i in range(len(order))]).select("g", "h")
    schema = T.StructType([dealt.schema["g"], T.StructField("n", T.LongType()), T.StructField("chain", T.StringType())])

    def fold(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        key, n, h = None, 0, ""
        for batch in batches:
            done = []
            for g, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n and g != key:
                    done.append((key, n, h))
                    n, h = 0, ""
                key, n = g, n + 1
                h = None if h is None or one is None else hashlib.sha256(f"{h}{n}\0{one.hex()}".encode()).hexdigest()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), out.types, strict=True)], schema=out)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((key, n, h), out.types, strict=True)], schema=out)

    chain = F.col("chain") if most is None else F.when(F.col("n") <= most, F.col("chain"))
    return dealt.mapInArrow(fold, schema).select(F.col("g").alias(group), "n", chain.alias("chain"))


# ---- precedence, anti joins, sets ----


def unmapped(samples: DataFrame, mapped_numbers: DataFrame, mapped_records: DataFrame, number: str, record: str) -> DataFrame:
    """Samples whose number is not mapped and which are not their mapped record's only sample."""
    count = samples.groupBy(record).agg(F.count("*").alias("__samples"))
    single = count.where("__samples = 1").join(mapped_records, record, "left_semi").select(record)
    return samples.join(mapped_numbers, number, "left_anti").join(single, record, "left_anti")


def by_precedence(branches: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """The union of branches (rows, name) in which each key's rows come from the first branch that has the key."""
    out, taken = None, None
    for rows, name in branches:
        own = rows if taken is None else rows.join(taken, key, "left_anti")
        out = own.withColumn("source", F.lit(name)) if out is None else out.unionByName(own.withColumn("source", F.lit(name)))
        keys = rows.select(key).distinct()
        taken = keys if taken is None else taken.unionByName(keys).distinct()
    return out


def last_of_each(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with the times that they stand in left and right, where these differ. One pass, aggregated map-side."""
    cols = left.columns
    both = left.select(*cols, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(right.select(*cols, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    return both.groupBy(*cols).agg(F.sum("__l").alias("n_left"), F.sum("__r").alias("n_right")).where("n_left != n_right")


def merge_assets(current: DataFrame, incoming: DataFrame, key: str, content: str, order: list[str]) -> DataFrame:
    """Content-hash upsert of (key, content): the first incoming row of each key counts; the outcome is imported, updated, duplicated or kept."""
    new = incoming.groupBy(key).agg(F.min_by(content, F.struct(*order)).alias("__c")).select(key, F.sha2("__c", 256).alias("new_hash"))
    old = current.select(key, F.sha2(content, 256).alias("old_hash"))
    both = old.join(new, key, "full")
    outcome = F.when(F.col("new_hash").isNull(), "kept").when(F.col("old_hash").isNull(), "imported").when(F.col("old_hash") == F.col("new_hash"), "duplicated").otherwise("updated")
    return both.select(key, F.coalesce("new_hash", "old_hash").alias("content_hash"), outcome.alias("outcome"))
