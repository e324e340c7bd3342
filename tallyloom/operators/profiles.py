"""Declarative profiles end to end: which profiles fit a document, what each of them reads, and which reading counts.

Profiles are few and are part of the plan; documents (key, payload as JSON text, fingerprint, grammar) are rows. A profile is a dict with
strategy, fingerprint, perhaps grammar, and

* structured_items_v1: items_path (dotted, `[]` fans out) and fields (order row field to key of the item);
* text_pipeline_v1: text_path, steps, perhaps item_split (what stands between items) and field_roles (field to token class);
* source_projection_v1: rows, each a dict from order row field to [token class, place, operations] over the spans of text_path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import text_value
from tallyloom.operators.evidence import matches_class, span_ranges, values_at_path
from tallyloom.operators.rules import ROW_FIELDS, project, row_of, run_steps, validation_errors
from tallyloom.operators.tasks import replay

COLUMNS = ("product", "sales_attr1", "sales_attr2", "quantity", "remark", "image_match_text", "status", "review_reason")


def compatible(docs: DataFrame, profile: dict) -> DataFrame:
    """Documents of the profile's fingerprint and, if it names one and isn't structured, of its grammar."""
    fits = docs.where(F.col("fingerprint") == profile["fingerprint"])
    return fits.where(F.col("grammar") == profile["grammar"]) if profile.get("grammar") and profile["strategy"] != "structured_items_v1" else fits


def _at(path: str) -> Column:
    return F.get_json_object("payload", f"$.{path}")


def _structured(docs: DataFrame, key: str, profile: dict) -> DataFrame:
    items = values_at_path(docs.select(key, "payload"), "payload", profile["items_path"])
    start = {f: F.get_json_object("value", f"$.{k}") for f, k in profile["fields"].items()}
    place = F.transform(F.regexp_extract_all("value_path", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda d: d.cast("int"))
    return run_steps(items.withColumn("place", place), start, profile.get("steps") or [], profile.get("defaults"))


def _text(docs: DataFrame, key: str, profile: dict) -> DataFrame:
    text, cut = _at(profile["text_path"]), profile.get("item_split")
    parts = F.split(text, "\\Q" + cut + "\\E", -1) if isinstance(cut, str) and cut else F.array(text)
    rows = docs.select(key, F.posexplode(parts).alias("__pos", "__text")).withColumn("place", F.array("__pos"))
    read = run_steps(rows, {"text": F.col("__text")}, profile.get("steps") or [], profile.get("defaults"))
    roles = profile.get("field_roles") or {}
    # a field with a role has to be of its class, as a whole; without roles nothing is known about the text
    ok = reduce(lambda a, b: a & b, [matches_class(F.col(f).cast("string"), F.lit(c)) for f, c in roles.items()], F.lit(bool(roles)))
    return read.where(ok)


def _projected(docs: DataFrame, key: str, profile: dict) -> DataFrame:
    text = _at(profile.get("text_path") or "text")
    spans = docs.select(key, text.alias("__text"), span_ranges(text).alias("__spans"))

    def picked(token_class: str, n: int, operations: list[dict]) -> Column:
        own = F.filter("__spans", lambda s: s["token_class"] == token_class)
        at = F.get(own, F.lit(n))
        return project(F.coalesce(F.substring("__text", at["start"].cast("int") + 1, (at["end"] - at["start"]).cast("int")), F.lit("")), operations)

    each = []
    for i, row in enumerate(profile["rows"]):
        values = {f: picked(*pick) for f, pick in row.items()} | {k: F.lit(v) for k, v in (profile.get("defaults") or {}).items() if k not in row}
        each.append(F.struct(F.array(F.lit(i)).alias("place"), *[c.alias(n) for n, c in row_of(values).items()]))
    return spans.select(key, F.explode(F.array(*each)).alias("r")).select(key, "r.*")


def profile_rows(docs: DataFrame, key: str, profile: dict) -> DataFrame:
    """(key, place, order row columns): what the profile reads from the documents that it fits; invalid profiles are refused."""
    wrong = validation_errors(profile)
    if wrong:
        raise ValueError(f"invalid profile: {', '.join(wrong)}")
    read = {"structured_items_v1": _structured, "text_pipeline_v1": _text, "source_projection_v1": _projected}[profile["strategy"]]
    rows = read(compatible(docs, profile), key, profile)
    return rows.select(key, "place", *[F.col(c).cast("bigint" if c == "quantity" else "string").alias(c) for c in COLUMNS])


def judged(docs: DataFrame, key: str, profiles: list[dict]) -> DataFrame:
    """(key, status, position, read) of each document: read holds the rows of the profile that counts, in order, and is null where none does.

    Profiles that give no row don't count. Several results that differ are profile_ambiguous; of equal ones the last profile's rows stay.
    Each document is read once by each profile, and its rows meet in one pass."""
    row = F.struct("place", *COLUMNS)
    none = F.array().cast("array<struct<place:array<int>," + ",".join(f"{c}:{'bigint' if c == 'quantity' else 'string'}" for c in COLUMNS) + ">>")
    if not profiles:
        return docs.select(key, F.lit("format_profile_missing").alias("status"), F.lit(None).cast("int").alias("position"), F.when(F.lit(False), none).alias("read"))
    all_rows = reduce(DataFrame.unionByName, [profile_rows(docs, key, p).withColumn("position", F.lit(i)) for i, p in enumerate(profiles)])
    results = all_rows.groupBy(key, "position").agg(F.array_sort(F.collect_list(row)).alias("read"))
    result = F.sha2(F.to_json(F.transform("read", lambda r: F.struct(*[r[c] for c in COLUMNS]))), 256)
    one = results.withColumn("result", result).groupBy(key).agg(F.min("result").alias("least"), F.max("result").alias("most"), F.max(F.struct("position", "read")).alias("last"))
    held = docs.select(key).distinct().join(one, key, "left")
    status = F.when(F.col("least").isNull(), "format_profile_missing").when(F.col("least") != F.col("most"), "profile_ambiguous").otherwise("parsed")
    return held.withColumn("status", status).select(key, "status", *[F.when(F.col("status") == "parsed", F.col(f"last.{c}")).alias(c) for c in ("position", "read")])


def parse_profiles(docs: DataFrame, key: str, profiles: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(status of each document, rows of those that are parsed); see judged()."""
    found = judged(docs, key, profiles)
    return found.select(key, "status", "position"), found.select(key, "position", F.explode("read").alias("r")).select(key, "position", "r.*")


def replay_profile(docs: DataFrame, key: str, profile: dict, expected: DataFrame) -> DataFrame:
    """expected (key, rows: products with quantities as text, in order) with passed: whether the profile reads exactly these."""
    rows = profile_rows(docs, key, profile)
    value = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("product", "sales_attr1", "sales_attr2", "quantity", "remark")])
    return replay(rows.select(key, "place", value.alias("value")), [key], expected)


__all__ = ["COLUMNS", "ROW_FIELDS", "compatible", "judged", "parse_profiles", "profile_rows", "replay_profile"]
