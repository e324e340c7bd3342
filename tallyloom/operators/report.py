"""Report lines from matched rows: defaults, stacking, natural order, layouts and stalls."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import natural_key, plain, positive_int, report_quantity

# Names and defaults that reports show.
NO_STALL = "未设置档口"
COLUMNS = ("product_name", "sales_attr1", "sku_image", "sales_attr2", "quantity", "remark", "image_match_text")
LABELS = ("商品", "销售属性1", "图片", "销售属性2", "数量", "备注", "图片匹配文本")
WIDTHS = (180, 180, 120, 120, 80, 180, 240)


def exportable(status: Column, product_id: Column, product_name: Column) -> Column:
    return F.coalesce((status == "matched") & (product_id.try_cast("bigint") > 0) & (plain(product_name) != ""), F.lit(False))


def dash(c: Column) -> Column:
    return F.coalesce(F.nullif(plain(c), F.lit("")), F.lit("-"))


def line_items(rows: DataFrame) -> DataFrame:
    """A report line for each exportable row (status, product_id, product_name, stall_id, stall_name, sku_id, image_id, sales_attr1,
    sales_attr2, quantity, remark, image_match_text, item_count), beside the other columns that rows has."""
    out = rows.where(exportable(F.col("status"), F.col("product_id"), F.col("product_name")))
    many = (F.coalesce(F.col("item_count"), F.lit(0)) > 1) & (plain(F.col("quantity")) == "")
    return out.withColumns(
        {
            "product_name": dash(F.col("product_name")),
            "stall_name": F.coalesce(F.nullif(plain(F.col("stall_name")), F.lit("")), F.lit(NO_STALL)),
            "spec": dash(F.col("sales_attr1")),
            "size_text": dash(F.col("sales_attr2")),
            "n": report_quantity(F.col("quantity"), F.when(many, 0).otherwise(1)),
            "remark": plain(F.col("remark")),
            "image_match_text": plain(F.col("image_match_text")),
        }
    )


def _natural(values: Column) -> Column:
    """Texts of an array in natural order, joined by spaces."""
    return F.array_join(F.transform(F.array_sort(F.transform(values, lambda v: F.struct(natural_key(v).alias("k"), v.alias("v")))), lambda s: s["v"]), " ")


def _repeated(sizes: Column) -> Column:
    """The size_text of each struct as often as its pieces say, in natural order, joined by spaces; the texts are sorted before they are repeated."""
    keyed = F.array_sort(F.transform(sizes, lambda s: F.struct(natural_key(s["size_text"]).alias("k"), s["size_text"].alias("v"), s["pieces"].alias("n"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat(F.repeat(F.concat(s["v"], F.lit(" ")), (s["n"] - 1).cast("int")), s["v"])), " ")


def _first_seen(pairs: Column) -> Column:
    """The distinct texts that aren't empty by their first place, joined by line feeds."""
    return F.array_join(F.array_distinct(F.transform(F.array_sort(F.filter(pairs, lambda p: p["v"] != "")), lambda p: p["v"])), "\n")


def stacked(items: DataFrame, order: list[str], stack_sizes: bool = False, with_texts: bool = True) -> DataFrame:
    """Lines of one stall, product, SKU (or spec) and image as one: quantities add up, specs and remarks are distinct, sizes stand
    once for each piece, or once if stack_sizes. `order` gives the rows' places. with_texts=False leaves the match texts empty.

    The first aggregation keeps a row for each distinct (group, spec, size, remark, text), with map-side combine, so that hot
    groups shrink before the second one gathers their values."""
    key = {
        "k_stall": F.coalesce(positive_int(F.col("stall_id")).cast("string"), F.col("stall_name")),
        "k_product": F.coalesce(positive_int(F.col("product_id")).cast("string"), F.col("product_name")),
        "k_sku": F.coalesce(positive_int(F.col("sku_id")).cast("string"), F.col("spec")),
        "k_image": F.coalesce(positive_int(F.col("image_id")).cast("string"), F.lit("0")),
    }
    at = F.struct(*order)
    items = items if with_texts else items.withColumn("image_match_text", F.lit(""))
    # a line of quantity 0 shows its size once
    pieces = F.greatest(F.col("n"), F.when(F.col("n") > 0, F.col("n")).otherwise(1))
    one = items.withColumns(key).groupBy(*key, "spec", "size_text", "remark", "image_match_text").agg(F.sum("n").alias("n"), F.sum(pieces).alias("pieces"), F.min(at).alias("at"), F.min_by(F.struct("stall_name", "product_name"), at).alias("first"))
    texts = lambda c: F.collect_set(F.struct(F.col("at"), F.col(c).alias("v")))
    two = one.groupBy(*key).agg(
        F.min_by("first", "at").alias("first"),
        F.collect_set("spec").alias("specs"),
        F.collect_list(F.struct("size_text", "pieces")).alias("sizes"),
        texts("remark").alias("remarks"),
        texts("image_match_text").alias("texts"),
        F.sum("n").alias("quantity"),
    )
    sizes = _natural(F.array_distinct(F.transform("sizes", lambda s: s["size_text"]))) if stack_sizes else _repeated(F.col("sizes"))
    return two.select("first.stall_name", "first.product_name", _natural(F.col("specs")).alias("spec"), sizes.alias("size_text"), F.col("quantity").cast("bigint").alias("quantity"), _first_seen(F.col("remarks")).alias("remark"), _first_seen(F.col("texts")).alias("image_match_text"))


def natural_order(lines: DataFrame) -> DataFrame:
    return lines.orderBy(*[natural_key(F.col(c)) for c in ("stall_name", "product_name", "spec", "size_text")])


def by_stall(lines: DataFrame) -> DataFrame:
    return lines.groupBy("stall_name").agg(F.count("*").alias("n_lines"), F.sum("quantity").cast("bigint").alias("quantity"))


def normalized_layout(layout: dict | str | None) -> dict:
    """A layout with every known column once, at least one of them visible, and sizes within limits; anything unreadable is the default."""
    if isinstance(layout, str):
        try:
            layout = json.loads(layout)
        except ValueError:
            layout = None
    layout = layout if isinstance(layout, dict) else {}

    def size(value, default: int, low: int, high: int) -> int:
        try:
            return max(low, min(high, round(float(value))))
        except (TypeError, ValueError, OverflowError):
            return default

    known = dict(zip(COLUMNS, zip(LABELS, WIDTHS, strict=True), strict=True))
    columns, seen = [], set()
    given = layout.get("columns") if isinstance(layout.get("columns"), list) else []
    for c in [*[g for g in given if isinstance(g, dict)], *[{"key": k} for k in COLUMNS]]:
        if c.get("key") in known and c["key"] not in seen:
            seen.add(c["key"])
            label, width = known[c["key"]]
            columns.append({"key": c["key"], "label": str(c.get("label") or label).strip() or label, "visible": c.get("visible") is not False, "width": size(c.get("width"), width, 40, 600)})
    if not any(c["visible"] for c in columns):
        columns[0]["visible"] = True
    return {"columns": columns, "stack_sales_attr1": bool(layout.get("stack_sales_attr1", True)), "stack_sales_attr2": bool(layout.get("stack_sales_attr2", False))}


def apply_layout(lines: DataFrame, layout: dict | str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The visible columns under their labels, after the columns `keep`; the image column is always empty text."""
    source = {"product_name": "product_name", "sales_attr1": "spec", "sales_attr2": "size_text", "quantity": "quantity", "remark": "remark", "image_match_text": "image_match_text"}
    return lines.select(*(keep or []), *[(F.col(source[c["key"]]) if c["key"] in source else F.lit("")).alias(c["label"]) for c in normalized_layout(layout)["columns"] if c["visible"]])
