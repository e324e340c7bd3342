"""Batches of raw records to order rows: payloads are checked, taken apart, routed by the rule pack and read, in one plan.

What is wrong with a record is data: each document has a row of diagnostics with its reason, if any, and no record keeps another from
being read. A batch (a task) has a status made of its documents' reasons.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import child_label, nonempty, once, parent_label, plain
from tallyloom.operators import nodes as N
from tallyloom.operators.drafts import draft_rows, pack_findings, preferred_texts
from tallyloom.operators.fingerprint import STRATEGIES, fingerprints, grammar_signature
from tallyloom.operators.profiles import COLUMNS, judged
from tallyloom.operators.reading import payload_documents, source_texts
from tallyloom.operators.tasks import MAX_CHARS, batch_status, json_depth
from tallyloom.sources.shared import work_folder

#: Reasons of records that are not read, in the order in which they are looked for; a capture's own warning comes before them.
TOO_LONG, NOT_JSON, TOO_DEEP = "payload_too_long", "payload_not_json", "payload_too_deep"
DECLARATIVE = "declarative_v1"


class Batch(NamedTuple):
    """rows: order rows with task, record, document and labels. diagnostics: a row for each document, with its reason or null.
    status: a row for each task, with its status and counts."""

    rows: DataFrame
    diagnostics: DataFrame
    status: DataFrame


def record_fault(payload: Column, warning: Column) -> Column:
    """Why a record is not read: the capture's warning, a payload that is too long, no JSON object or nested too deep; else null."""
    fits = F.when(F.length(payload) <= MAX_CHARS, payload)
    bad = F.when(F.coalesce(F.length(payload) > MAX_CHARS, F.lit(False)), TOO_LONG).when(json_depth(fits) > N.DEEPEST, TOO_DEEP).when(N.as_object(F.try_parse_json(fits)).isNull(), NOT_JSON)
    return F.coalesce(nonempty(plain(warning)), bad)


def batch_documents(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents of the records that can be read, one row with its reason for each document of the others).

    records have task_id, record_id, component, payload, and may have warning, sequence and source_index. A document keeps the envelope of its task, so
    that paths of profiles read alike for one and several documents. A quarantined record counts as many documents as it holds."""
    given = {"warning": "string", "sequence": "bigint", "source_index": "string"}
    held = records.select("*", *[F.lit(None).cast(t).alias(c) for c, t in given.items() if c not in records.columns])
    held = once(held, "fault", record_fault(F.col("payload"), F.col("warning")))
    parts = payload_documents(held.withColumn("__payload", F.when(F.col("fault").isNull() | ~F.col("fault").isin(TOO_LONG, NOT_JSON, TOO_DEEP), F.col("payload"))), "__payload")
    place = F.col("document_pos").cast("bigint")
    whole = F.col("document") == F.col("__payload")
    envelope = F.when(whole, F.col("document")).otherwise(F.concat(F.lit('{"task":{"documents":['), F.col("document"), F.lit("]}}")))
    label = parent_label(F.col("source_index"), F.col("record_id"), F.col("sequence") + place)
    docs = parts.select("task_id", "record_id", place.alias("document"), "component", "fault", F.concat_ws("#", "record_id", "document_pos").alias("doc"), envelope.alias("payload"), label.alias("parent_label"))
    return docs.where("fault is null").drop("fault"), docs.where("fault is not null").select("task_id", "record_id", "document", "parent_label", F.lit(None).cast("string").alias("fingerprint"), F.col("fault").alias("reason"))


def _written(df: DataFrame) -> DataFrame:
    """df as a work table, so that what several results are made of is worked out once."""
    path = work_folder(df.sparkSession, "batch")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _declarative(docs: DataFrame, policy: dict) -> DataFrame:
    """(doc, fingerprint, reason, rows in order) of each document, by the pack's profiles."""
    found = fingerprints(docs, "payload", "component", policy.get("fingerprint_strategy") or STRATEGIES[0])
    marked = _written(found.select("doc", "payload", "fingerprint", grammar_signature(F.col("print_texts"), exact=False).alias("grammar")))
    each = marked.select("doc", "fingerprint").join(judged(marked, "doc", policy["format_profiles"]), "doc")
    open_ = F.coalesce(F.exists("read", lambda r: r["status"] == "needs_review"), F.lit(False))
    reason = F.when(F.col("status") != "parsed", F.col("status")).when(open_, "format_profile_incomplete")
    return each.select("doc", "fingerprint", reason.alias("reason"), F.transform("read", lambda r: F.struct(*[r[c].alias(c) for c in COLUMNS])).alias("read"))


def _heuristic(docs: DataFrame, policy: dict) -> DataFrame:
    """(doc, fingerprint, reason, rows in order) of each document, by the text parser over its best source of texts; no reasons."""
    blocks = source_texts(docs.select("doc", "payload"), ["doc"], "payload", F.lit(""))
    best = preferred_texts(blocks, ["doc"], "path", ["text_order"])
    texts = best.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text_order", "text"))), lambda t: t["text"]), "\n").alias("text"))  # one document's texts
    rows = draft_rows(docs.select("doc").join(texts, "doc", "left"), "doc", "text", keywords=[(k["keyword"], k.get("reason", "")) for k in policy.get("special_keywords") or []], policy=policy)
    read = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("row_index", *COLUMNS))).alias("read"))  # one document's rows
    none = F.lit(None).cast("string")
    return read.select("doc", none.alias("fingerprint"), none.alias("reason"), F.transform("read", lambda r: F.struct(*[r[c].alias(c) for c in COLUMNS])).alias("read"))


def parse_batch(records: DataFrame, pack: dict | None) -> Batch:
    """Order rows, diagnostics and status of records (see batch_documents) under a rule pack; without a valid pack nothing is read."""
    errors = [] if pack is None else pack_findings(pack)[0]
    if pack is None or errors:
        state = "rule_pack_missing" if pack is None else "rule_pack_invalid"
        none = records.where("false")
        rows = none.select("task_id", "record_id", *[F.lit(None).cast("string").alias(c) for c in COLUMNS])
        faults = none.select("task_id", "record_id", F.lit(None).cast("string").alias("reason"))
        return Batch(rows, faults, records.select("task_id").distinct().withColumn("parse_status", F.lit(state)))
    policy = pack["parser_policy"]
    docs, faults = batch_documents(records)
    docs = _written(docs)
    found = (_declarative if policy.get("order_row_parser") == DECLARATIVE else _heuristic)(docs, policy)
    read = docs.select("task_id", "record_id", "document", "doc", "parent_label").join(found, "doc")
    # a document with a reason gives no rows
    kept = read.where("reason is null").select("task_id", "record_id", "document", "parent_label", F.size("read").alias("child_count"), F.posexplode("read").alias("pos", "r"))
    index = (F.col("pos") + 1).cast("bigint")
    rows = kept.select("task_id", "record_id", "document", index.alias("row_index"), "parent_label", child_label(F.col("parent_label"), index, F.col("child_count")).alias("child_label"), *[F.col(f"r.{c}").alias(c) for c in COLUMNS])
    diagnostics = read.select("task_id", "record_id", "document", "parent_label", "fingerprint", "reason").unionByName(faults)
    counts = diagnostics.groupBy("task_id").agg(F.count("*").alias("parent_count"), F.count_if(F.col("reason").isNotNull()).alias("unresolved_count"))
    children = rows.groupBy("task_id").agg(F.count("*").alias("child_count"))
    status = batch_status(diagnostics, ["task_id"], "reason").join(counts, "task_id").join(children, "task_id", "left")
    return Batch(rows, diagnostics, status.withColumn("child_count", F.coalesce("child_count", F.lit(0).cast("bigint"))))
