"""Workbooks as rows of sheets: reports with their exceptions, document exports, and the difference of two workbooks.

All functions give or take rows (book, sheet, row, cells), which sources.workbook writes and reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import plain, safe_cell

#: The sheet of the rows that a report leaves out, and its columns.
EXCEPTIONS = "exceptions"
EXCEPTION_COLUMNS = ("parent_label", "product", "sales_attr1", "sales_attr2", "quantity", "remark", "reason")
MODES = ("merged_sheet", "stall_sheet", "stall_workbooks")


def sheet_rows(rows: DataFrame, book: Column, sheet: Column, order: list[Column | str], columns: dict[str, Column]) -> DataFrame:
    """rows as sheets with a row of labels: columns are the cells' labels and values. Values that would be formulas are guarded.

    A sheet's rows are numbered in one group, as they go to one file anyway."""
    cells = F.array(*[F.coalesce(safe_cell(c.cast("string")), F.lit("")) for c in columns.values()])
    placed = rows.select(book.alias("book"), sheet.alias("sheet"), F.struct(*order).alias("__order"), cells.alias("cells"))
    body = placed.withColumn("row", F.row_number().over(Window.partitionBy("book", "sheet").orderBy("__order", "cells")).cast("bigint") + 1)
    head = placed.select("book", "sheet").distinct().select("book", "sheet", F.lit(1).cast("bigint").alias("row"), F.array(*[F.lit(c) for c in columns]).alias("cells"))
    return head.unionByName(body.select("book", "sheet", "row", "cells"))


def report_books(lines: DataFrame, exceptions: DataFrame, stall: str, order: list[Column | str], columns: dict[str, Column], mode: str = "stall_sheet", name: str = "report") -> DataFrame:
    """A report in one of MODES: one sheet, a sheet for each stall, or a book for each stall; the exceptions are a sheet of the report's
    book, or a book of their own beside the stalls' books. They have EXCEPTION_COLUMNS, in the order of their parents."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    of = F.coalesce(F.nullif(plain(F.col(stall)), F.lit("")), F.lit("-"))
    book, sheet = {"merged_sheet": (F.lit(name), F.lit(name)), "stall_sheet": (F.lit(name), of), "stall_workbooks": (F.concat(F.lit(f"{name} "), of), of)}[mode]
    left_out = sheet_rows(exceptions, F.lit(f"{name} {EXCEPTIONS}" if mode == "stall_workbooks" else name), F.lit(EXCEPTIONS), ["parent_label"], {c: F.col(c) for c in EXCEPTION_COLUMNS})
    return sheet_rows(lines, book, sheet, order, columns).unionByName(left_out)


# ---- differences ----


def trimmed(cells: Column) -> Column:
    """The cells up to the last one that isn't blank."""
    last = F.array_max(F.transform(cells, lambda c, i: F.when(plain(c) != "", i + 1)))
    return F.slice(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), F.lit(1), F.coalesce(last, F.lit(0)))


def _rows(book: DataFrame, key: list[str]) -> DataFrame:
    held = book.select(*key, "row", trimmed(F.col("cells")).alias("cells")).where(F.size("cells") > 0)  # blank rows say nothing
    return held.withColumn("content", F.sha2(F.to_json("cells"), 256))


def workbook_diff(left: DataFrame, right: DataFrame, key: list[str] = ("book", "sheet")) -> DataFrame:
    """(key, kind, row, col, left_value, right_value, moved_to) of what differs between two workbooks, by sheet, row and column.

    Rows that stand elsewhere in the same sheet are `moved` (from row, to moved_to), copies of a row in their order. Cells of the other
    rows are `changed`, `missing` on the right or `added` there. Blank cells at the end of a row, and blank rows, don't count.

    Books are sorted and merged: a broadcast of rows whose compressed file looks small would bring them all to the driver."""
    key = list(key)
    one, two = (_rows(b, key) for b in (left, right))
    same = one.hint("merge").join(two, [*key, "row", "content"]).select(*key, "row")
    apart = []
    for b in (one, two):
        rest = b.hint("merge").join(same, [*key, "row"], "left_anti")
        apart.append(rest.withColumn("copy", F.row_number().over(Window.partitionBy(*key, "content").orderBy("row"))))
    a, b = apart
    moved = a.select(*key, "content", "copy", "row").hint("merge").join(b.select(*key, "content", "copy", F.col("row").alias("moved_to")), [*key, "content", "copy"])
    gone = moved.select(*key, "row", F.lit("moved").alias("kind"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value"), "moved_to")
    cells = []
    for side, at in ((a, "row"), (b, "moved_to")):
        open_rows = side.hint("merge").join(moved.select(*key, F.col(at).alias("row")), [*key, "row"], "left_anti")
        cells.append(open_rows.select(*key, "row", F.posexplode("cells").alias("col", "value")).where("value != ''"))
    both = cells[0].withColumnRenamed("value", "left_value").hint("merge").join(cells[1].withColumnRenamed("value", "right_value"), [*key, "row", "col"], "full")
    kind = F.when(F.col("left_value").isNull(), "added").when(F.col("right_value").isNull(), "missing").otherwise("changed")
    differ = both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    out = differ.select(*key, "row", kind.alias("kind"), (F.col("col") + 1).alias("col"), "left_value", "right_value", F.lit(None).cast("bigint").alias("moved_to"))
    return gone.unionByName(out).select(*key, "kind", "row", "col", "left_value", "right_value", "moved_to")


def image_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Images (book, sheet, row, col, sha256) that stand on one side only, with how many of them do."""
    key = ["book", "sheet", "row", "col", "sha256"]
    count = lambda d, n: d.groupBy(*key).agg(F.count("*").alias(n))
    both = count(left, "l").join(count(right, "r"), key, "full").na.fill(0, ["l", "r"])
    return both.where("l != r").select(*key, F.when(F.col("l") > F.col("r"), "missing").otherwise("added").alias("kind"), F.abs(F.col("l") - F.col("r")).alias("n"))
