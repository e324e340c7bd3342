"""The order text parser as columns: items of texts, and the row of each item by an ordered chain of readings.

Every column here is one Arrow function, so that the chain takes no room in the plan, and equal texts of a batch are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.arrow import per_text
from tallyloom.functions.text import FIELD_LABEL, compact, nonempty
from tallyloom.operators import readings as R

ROW = "product string, sales_attr1 string, sales_attr2 string, quantity bigint, remark string, status string, review_reason string, image_match_text string, original_text string"
ITEMS = "array<string>"
#: A text's items and what set them apart.
BOUNDED = "items array<string>, boundary string"


def special_reason(text: Column, keywords: list[tuple[str, str]]) -> Column:
    """The reason of the first keyword that the text contains; null if none."""
    t = compact(text)
    return F.coalesce(*[F.when(t.contains(k), r or "special_waybill") for k, r in keywords], F.lit(None).cast("string"))


def parse_items(rows: DataFrame, text: str, fallback_quantity: Column | None = None, remark: Column | None = None, keywords: list[tuple[str, str]] = (), policy: dict | None = None, default_quantity: int | None = None) -> DataFrame:
    """rows with the fields of the item in column `text`, by the first reading that fits: special keyword, labels only, two lines, attribute
    and size before or behind the product, bracket title, comma fields, semicolon size, tail.

    Remark lines at the end go to the remark first. A missing product or quantity makes the row needs_review, unless the policy says otherwise."""
    if default_quantity is not None:
        policy = {"quantity": {"default_if_missing": default_quantity}} | (policy or {})
    keywords = list(keywords)
    read = per_text(lambda t, f, n: R.read_safely(t, f, n, keywords, policy), ROW)
    empty = F.lit("")
    got = rows.withColumn("__row", read(F.col(text), empty if fallback_quantity is None else fallback_quantity, empty if remark is None else remark))
    return got.withColumns({f.split(" ")[0]: F.col(f"__row.{f.split(' ')[0]}") for f in ROW.split(", ")}).drop("__row")


#: Columns of texts: their items; items with their boundary; N products and N label lines as N items; comma fields outside brackets.
split_items = per_text(R.split_items, ITEMS)
boundary_items = per_text(lambda t: dict(zip(("items", "boundary"), R.boundary_items(t), strict=True)), BOUNDED)
item_texts = per_text(R.item_texts, ITEMS)
paired_lines = per_text(R.paired_lines, ITEMS)
comma_parts = per_text(lambda t: R.comma_parts(t or ""), ITEMS)
normalized_product = per_text(lambda t: R.normalized_product(t or ""), "string")


def _named(read, *names: str):
    """A column of a reading as a struct; null where it doesn't fit."""
    return per_text(lambda t: dict(zip(names, got, strict=True)) if (got := read(t or "")) else None, ", ".join(f"{n} string" for n in names))


semicolon_size = _named(R.semicolon_size, "rest", "size")
attr1_suffix = _named(R.attr1_suffix, "product", "sales_attr1")
simple_attrs = _named(R.simple_attrs, "sales_attr1", "sales_attr2")
labelled = _named(R.labelled, "sales_attr1", "sales_attr2")


def candidate_texts(lines: Column) -> Column:
    """The lines (an array, of one sample) put together to items of one to three lines."""
    joined = F.array_join(F.transform(lines, lambda t: F.regexp_replace(t, r"[\r\n]+", " ")), "\n")
    return per_text(lambda t: R.candidate_texts((t or "").split("\n")), ITEMS)(joined)


__all__ = ["FIELD_LABEL", "boundary_items", "candidate_texts", "item_texts", "labelled", "nonempty", "paired_lines", "parse_items", "special_reason", "split_items"]
