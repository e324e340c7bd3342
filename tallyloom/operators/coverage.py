"""The coverage gate: every expected parent document ends in exactly one of normal and exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import first_nonempty, plain
from tallyloom.operators.report import exportable

BUSINESS = ("product_text", "sales_attr1_text", "sales_attr2_text", "quantity_text", "remark_text")
# Failures and warnings, in the order in which they are told.
FAILURES = ("expected_parent_trace_missing", "expected_parent_identity_collision", "parent_count_mismatch", "raw_record_uncovered", "source_trace_missing", "export_coverage_mismatch", "exception_not_actionable", "parent_partition_incomplete")
WARNINGS = ("duplicate_child_rows", "high_child_count", "mixed_parent_outcomes")
HIGH_CHILD_COUNT = 10


def exception_text(*texts: Column) -> Column:
    return first_nonempty(*texts)


def parents(rows: DataFrame) -> DataFrame:
    """A row for each parent (raw_record_id, parent_sequence): its rows, outcome and warnings.

    Rows have status, product_id, product_name, the BUSINESS texts and exception (text). They are counted by distinct business
    texts first, so a parent with many equal rows is one row before its key is shuffled again."""
    ok = exportable(F.col("status"), F.col("product_id"), F.col("product_name"))
    judged = rows.where("raw_record_id is not null and parent_sequence is not null").withColumns({"ok": ok, "said": plain(F.col("exception")) != ""})
    same = judged.groupBy("raw_record_id", "parent_sequence", *[plain(F.col(b)).alias(b) for b in BUSINESS]).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok") & ~F.col("said")).alias("n_mute"))
    whole = same.groupBy("raw_record_id", "parent_sequence").agg(F.sum("n").alias("n"), F.sum("n_ok").alias("n_ok"), F.sum("n_mute").alias("n_mute"), F.sum(F.col("n") - 1).alias("n_duplicate"))
    outcome = F.when(F.col("n_ok") == F.col("n"), "normal").when(F.col("n_mute") == 0, "exception").otherwise("not_actionable")
    return whole.withColumns({"outcome": outcome, "mixed": (F.col("n_ok") > 0) & (F.col("n_ok") < F.col("n")), "high": F.col("n") > HIGH_CHILD_COUNT})


def coverage(expected: DataFrame, rows: DataFrame, normal_exports: Column | None = None, exception_exports: Column | None = None) -> DataFrame:
    """One row of counts for expected parents (raw_record_id, parent_sequence) and result rows. Exports default to the exportable rows and the others."""
    ok = exportable(F.col("status"), F.col("product_id"), F.col("product_name"))
    keyless = F.col("raw_record_id").isNull() | F.col("parent_sequence").isNull()
    want = expected.agg(F.count("*").alias("n_expected"), F.count_if(keyless).alias("n_missing"))
    got = rows.agg(F.count("*").alias("n_rows"), F.count_if(keyless).alias("n_keyless"), F.count_if(ok).alias("n_ok"))
    keys = expected.where(~keyless).groupBy("raw_record_id", "parent_sequence").agg(F.count("*").alias("n_times"))
    seen = parents(rows)
    both = keys.join(seen, ["raw_record_id", "parent_sequence"], "full")
    covered = F.coalesce(F.col("outcome").isin("normal", "exception"), F.lit(False))
    one = both.agg(
        F.coalesce(F.sum(F.col("n_times") - 1), F.lit(0)).alias("n_collision"),
        F.count("n").alias("n_recognized"),
        F.count_if(F.col("outcome") == "normal").alias("n_normal"),
        F.count_if(F.col("outcome") == "exception").alias("n_exception"),
        F.count_if(F.col("outcome") == "not_actionable").alias("n_mute"),
        F.count_if(F.col("n_times").isNotNull() != covered).alias("n_gap"),
        F.coalesce(F.sum("n_duplicate"), F.lit(0)).alias("n_duplicate"),
        F.count_if("high").alias("n_high"),
        F.count_if("mixed").alias("n_mixed"),
    )
    raw = both.groupBy("raw_record_id").agg(F.max(F.col("n_times").isNotNull()).alias("wanted"), F.max(F.col("n").isNotNull()).alias("found")).agg(F.count_if(F.col("wanted") & ~F.col("found")).alias("n_uncovered"))
    all_ = F.broadcast(want).crossJoin(F.broadcast(got)).crossJoin(F.broadcast(one)).crossJoin(F.broadcast(raw))  # one row each
    normal = normal_exports if normal_exports is not None else F.col("n_ok")
    special = exception_exports if exception_exports is not None else F.col("n_rows") - F.col("n_ok")
    counts = dict(zip(FAILURES, (F.col("n_missing"), F.col("n_collision"), F.abs(F.col("n_expected") - F.col("n_recognized")), F.col("n_uncovered"), F.col("n_keyless"), F.abs(F.col("n_rows") - normal - special), F.col("n_mute"), F.col("n_gap")), strict=True))
    warned = dict(zip(WARNINGS, (F.col("n_duplicate"), F.col("n_high"), F.col("n_mixed")), strict=True))
    told = lambda d: F.filter(F.array(*[F.struct(F.lit(k).alias("code"), v.cast("bigint").alias("n")) for k, v in d.items()]), lambda s: s["n"] > 0)
    return all_.select(
        (F.size(told(counts)) == 0).alias("ok"),
        F.col("n_expected").alias("expected_parent_count"),
        F.col("n_recognized").alias("recognized_parent_count"),
        (F.col("n_normal") + F.col("n_exception")).alias("covered_parent_count"),
        F.col("n_normal").alias("normal_parent_count"),
        F.col("n_exception").alias("exception_parent_count"),
        F.col("n_rows").alias("result_row_count"),
        told(counts).alias("failures"),
        told(warned).alias("warnings"),
    )


def failures(report: DataFrame) -> DataFrame:
    """(code, n) of the failures, then the warnings."""
    return report.select(F.explode(F.concat("failures", "warnings")).alias("f")).select("f.code", "f.n")


def require_complete(report: DataFrame, lines: DataFrame) -> DataFrame:
    """lines, or an error when the report isn't ok; the report has one row."""
    gate = report.select(F.when(~F.col("ok"), F.raise_error(F.concat(F.lit("coverage is not complete: "), F.to_json("failures")))).alias("__gate"))
    return lines.crossJoin(F.broadcast(gate)).where(F.col("__gate").isNull()).drop("__gate")
