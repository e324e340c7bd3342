"""Draft order rows: which texts of a parent are read, how they fall into items, and what stands for a parent that gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import compact, nonempty, plain, quantity_from_text, text_value
from tallyloom.operators.parse import item_texts, parse_items

# Sources of item texts by priority, and reasons of parents without rows.
SOURCES = ("productShortInfo", "productInfo", "ITEM_INFO", "customContent", "printXML")
NO_PRODUCT, NO_TEXT = "no_product_text", "no_readable_waybill_text"


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text_value(text), r"[\r\n]+"), compact), lambda t: t != "")


def first_of_keys(values: Column, keys: list[str]) -> Column:
    """The first text that isn't blank of a map's keys, in the keys' order; else empty."""
    return F.coalesce(*[nonempty(plain(F.element_at(values, k))) for k in keys], F.lit(""))


def source_rank(path: Column) -> Column:
    """The place of a path's source among SOURCES, or one behind them."""
    return F.coalesce(*[F.when(path.contains(s), i) for i, s in enumerate(SOURCES)], F.lit(len(SOURCES)))


def preferred_texts(blocks: DataFrame, key: list[str], path: str, order: list[str]) -> DataFrame:
    """The blocks of each key's best source; of one source, only those of its first path."""
    first = F.min(F.struct(F.struct(source_rank(F.col(path)).alias("r"), *order).alias("rank"), path)).over(Window.partitionBy(*key))
    return blocks.withColumn("__best", first[path]).where(F.col(path) == F.col("__best")).drop("__best")


def draft_rows(parents: DataFrame, key: str, text: str, quantity: str | None = None, remark: str | None = None, **options) -> DataFrame:
    """Rows of parse_items() for every item of each parent, numbered from 1; a parent without items has one row that needs review."""
    fallback = F.col(quantity) if quantity else F.lit("")
    items = parents.withColumn("__items", item_texts(F.col(text), fallback))
    each = items.select("*", F.posexplode_outer("__items").alias("__pos", "__item")).drop("__items")
    read = parse_items(each, "__item", F.when(F.col("__pos").isNotNull(), fallback).otherwise(""), F.col(remark) if remark else None, **options)
    none = F.col("__pos").isNull()
    why = F.when(text_value(F.col(text)) == "", NO_TEXT).otherwise(NO_PRODUCT)
    read = read.withColumns({"review_reason": F.when(none, why).otherwise(F.col("review_reason")), "status": F.when(none, "needs_review").otherwise(F.col("status")), "row_index": F.coalesce(F.col("__pos"), F.lit(0)) + 1})
    return read.drop("__pos", "__item")


def quarantined(records: DataFrame, key: str, warning: str, n_documents: str) -> DataFrame:
    """A parent without rows for each document of a record with an assignment warning, with the warning as its reason."""
    some = records.where(plain(F.col(warning)) != "")
    place = F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce(n_documents, F.lit(1)), F.lit(1)).cast("int")))
    return some.select(key, place.alias("document"), plain(F.col(warning)).alias("reason"), F.lit(0).alias("child_count"))


def zipped_items(products: Column, shorts: Column, counts: Column) -> Column:
    """struct(product, short, quantity) of lines with the same place; missing lines are empty, and only lines with a product or short count."""
    both = F.arrays_zip(lines_of(products).alias("p"), lines_of(shorts).alias("s"), lines_of(counts).alias("c"))
    each = F.transform(both, lambda z: F.struct(F.coalesce(z["p"], F.lit("")).alias("product"), F.coalesce(z["s"], F.lit("")).alias("short"), quantity_from_text(F.coalesce(z["c"], F.lit("")), F.coalesce(z["p"], F.lit(""))).alias("quantity")))
    return F.filter(each, lambda i: (i["product"] != "") | (i["short"] != ""))


def total_quantity(total: Column, items: Column) -> Column:
    """The stated total, else the sum of the items' quantities if all are known; else null."""
    stated = quantity_from_text(total)
    known = (F.size(items) > 0) & F.forall(items, lambda i: i["quantity"].isNotNull())
    return F.coalesce(stated, F.when(known, F.aggregate(items, F.lit(0).cast("bigint"), lambda n, i: n + i["quantity"])))


def structure_key(present: dict[str, Column]) -> Column:
    """Twelve hex digits for which fields hold text: SHA-1 of their flags as JSON, by name."""
    flags = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), (plain(present[n]) != "").cast("string")) for n in sorted(present)])
    return F.substring(F.sha1(F.concat(F.lit("{"), flags, F.lit("}"))), 1, 12)


def pack_findings(pack: dict) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a rule pack: what keeps it from being used, and what has no effect."""
    from tallyloom.operators.rules import validation_errors

    errors = [k for k in ("code", "name", "version") if not str(pack.get(k) or "").strip()]
    policy = pack.get("parser_policy")
    if not isinstance(policy, dict):
        return [*errors, "parser_policy"], []
    profiles = policy.get("format_profiles") or []
    warnings, seen = [], set()
    for i, p in enumerate(profiles):
        errors += [f"parser_policy.format_profiles[{i}].{e}" for e in (validation_errors(p) if isinstance(p, dict) else ["profile"])]
        slot = (p.get("fingerprint"), p.get("strategy"), p.get("grammar")) if isinstance(p, dict) else None
        if slot in seen:
            warnings.append(f"parser_policy.format_profiles[{i}] has the slot of an earlier one")
        seen.add(slot)
    known = {"format_profiles", "label_cleanup", "size_normalization", "quantity", "manual_label_only", "non_shoe", "special_keywords"}
    return errors, warnings + [f"parser_policy.{k} is not known" for k in sorted(set(policy) - known)]
