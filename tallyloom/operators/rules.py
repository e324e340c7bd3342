"""Declarative format profiles, compiled to column expressions: text steps, three strategies, completeness and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import QUANTITY, compact, first_nonempty, plain, quantity_from_text, remove_field_label, strip_trailing_quantity, text_value

ROW_FIELDS = ("product", "sales_attr1", "sales_attr2", "quantity", "remark", "image_match_text")
MAX_QUANTITY = 100_000
OPERATIONS = ("split", "rsplit", "extract_between", "trim", "strip_prefix", "strip_suffix", "collapse_whitespace", "to_positive_int")
PROJECTIONS = ("collapse_adjacent_delimiters", "extract_quantity", "split_part", "strip_field_label", "strip_trailing_quantity")


def positive_int(c: Column) -> Column:
    """1 to MAX_QUANTITY, from digits only; else null."""
    t = text_value(c)
    n = F.when(t.rlike(r"^\d{1,9}$"), t.try_cast("int"))
    return F.when(n.between(1, MAX_QUANTITY), n)


def _literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def apply_step(state: dict[str, Column], step: dict) -> None:
    """Changes state (name to column) as the step says."""
    op = step["op"]
    if op not in OPERATIONS:
        raise ValueError(f"unknown operation {op!r}")
    if op in ("split", "rsplit"):
        source, d, targets = text_value(state.get(step.get("source", "text"), F.lit(""))), step["delimiter"], step["targets"]
        parts = F.split(source, _literal(d), len(targets) if op == "split" else -1)
        if op == "rsplit":
            keep = len(targets) - 1
            head = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - keep, F.lit(1))), d)
            parts = F.when(F.size(parts) > len(targets), F.concat(F.array(head), F.slice(parts, -keep, keep) if keep else F.array().cast("array<string>"))).otherwise(parts)
        for i, t in enumerate(targets):
            state[t] = F.coalesce(plain(F.get(parts, F.lit(i))), F.lit(""))
        return
    target = step["target"]
    source = step.get("source", target)
    v = text_value(state.get(source, F.lit("")))
    if op == "extract_between":
        a, b = step["start"], step["end"]
        at = F.instr(v, F.lit(a))
        rest = F.substring(v, at + len(a), F.length(v))
        stop = F.instr(rest, F.lit(b))
        found = (at > 0) & (stop > 0)
        inner = F.substring(rest, F.lit(1), stop - 1)
        got = F.concat(F.lit(a), inner, F.lit(b)) if step.get("include_delimiters") else inner
        got = F.when(found, plain(got)).otherwise("")
        if step.get("consume"):
            left = plain(F.concat(F.substring(v, F.lit(1), at - 1), F.substring(rest, stop + len(b), F.length(v))))
            state[source] = F.when(got != "", left).otherwise(v)
        state[target] = got
    elif op == "trim":
        state[target] = F.btrim(v, F.lit(step["chars"])) if isinstance(step.get("chars"), str) else v
    elif op == "strip_prefix":
        state[target] = F.when(v.startswith(step["literal"]), plain(F.substring(v, F.lit(len(step["literal"]) + 1), F.length(v)))).otherwise("")
    elif op == "strip_suffix":
        state[target] = F.when(v.endswith(step["literal"]), plain(F.substring(v, F.lit(1), F.length(v) - len(step["literal"])))).otherwise("")
    elif op == "collapse_whitespace":
        state[target] = plain(F.regexp_replace(v, r"(?U)\s+", " "))
    else:
        state[target] = positive_int(v)


def project(value: Column, operations: list[dict]) -> Column:
    """The value of a span after the operations of a projection part."""
    out = compact(value)
    for o in operations:
        if o["op"] not in PROJECTIONS:
            raise ValueError(f"unknown operation {o['op']!r}")
        if o["op"] == "collapse_adjacent_delimiters":
            out = F.regexp_replace(out, r"([,，;；|/、])(?:\s*\1)+", "$1")
        elif o["op"] == "extract_quantity":
            out = F.coalesce(quantity_from_text(out).cast("string"), F.lit(""))
        elif o["op"] == "split_part":
            out = F.coalesce(plain(F.get(F.split(out, _literal(o["delimiter"]), -1), F.lit(o["index"]))), F.lit(""))
        elif o["op"] == "strip_field_label":
            out = remove_field_label(out)
        else:
            out = strip_trailing_quantity(out)["head"]
    return compact(out)


def row_of(values: dict[str, Column]) -> dict[str, Column]:
    """The columns of an order row, with status and review reason, from field values."""
    text = {f: text_value(values.get(f, F.lit(""))) for f in ("product", "sales_attr1", "sales_attr2", "remark")}
    quantity = positive_int(values.get("quantity", F.lit(None)))
    joined = F.array_join(F.filter(F.array(*text.values()), lambda t: t != ""), " ")
    no_product, no_quantity = text["product"] == "", quantity.isNull()
    reason = F.when(no_product & no_quantity, "missing_product_quantity").when(no_product, "missing_product").when(no_quantity, "missing_quantity").otherwise("")
    return text | {"quantity": quantity, "image_match_text": first_nonempty(text_value(values.get("image_match_text", F.lit(""))), joined), "status": F.when(reason == "", "draft").otherwise("needs_review"), "review_reason": reason}


def run_steps(rows: DataFrame, start: dict[str, Column], steps: list[dict], defaults: dict | None = None) -> DataFrame:
    """rows with the columns of an order row: defaults, then fields of `start` (a mapped field overrides its default even with null), then steps."""
    state = {k: F.lit(v) for k, v in (defaults or {}).items()} | dict(start)
    for s in steps:
        apply_step(state, s)
    return rows.withColumns(row_of(state))


def completeness(rows: DataFrame, parent: list[str]) -> DataFrame:
    """For each parent with rows: whether it is complete, and the reasons why not."""
    mark = F.coalesce(F.col("sales_attr1").rlike(QUANTITY), F.lit(False)) | F.coalesce(F.col("sales_attr2").rlike(QUANTITY), F.lit(False))
    tests = {"missing_product": F.col("product") == "", "missing_quantity": F.col("quantity").isNull() | (F.col("quantity") <= 0), "multiple_products_collapsed": F.col("product").rlike(r"[\r\n]"), "quantity_marker_in_sales_attribute": mark}
    flags = rows.groupBy(*parent).agg(*[F.bool_or(c).alias(k) for k, c in tests.items()])
    return flags.select(*parent, (~(F.col("missing_product") | F.col("missing_quantity") | F.col("multiple_products_collapsed") | F.col("quantity_marker_in_sales_attribute"))).alias("complete"), F.array_join(F.array_compact(F.array(*[F.when(F.col(k), k) for k in tests])), ",").alias("reasons"))


def resolve_profiles(candidates: DataFrame, parent: list[str], position: str, result: str) -> DataFrame:
    """For each parent, over the compatible profiles' results (null where a profile isn't): none is format_profile_missing, several different ones are profile_ambiguous, else the last profile wins."""
    one = candidates.groupBy(*parent).agg(F.count_distinct(result).alias("n"), F.max(F.when(F.col(result).isNotNull(), F.struct(position, result))).alias("last"))
    status = F.when(F.col("n") == 0, "format_profile_missing").when(F.col("n") > 1, "profile_ambiguous").otherwise("parsed")
    return one.select(*parent, status.alias("status"), F.when(F.col("n") == 1, F.col("last")[position]).alias(position))


def validation_errors(profile: dict) -> list[str]:
    """Paths of what is wrong in a profile, in order; no user patterns or scripts are taken."""
    wrong = []
    kinds = {"structured_items_v1": ("items_path", "fields"), "text_pipeline_v1": ("text_path",), "source_projection_v1": ("rows",)}
    need = kinds.get(profile.get("strategy"))
    if need is None:
        return ["strategy"]
    wrong += [k for k in ("fingerprint", *need) if not profile.get(k)]
    for i, s in enumerate(profile.get("steps") or []):
        at = f"steps[{i}]"
        if not isinstance(s, dict) or s.get("op") not in OPERATIONS:
            wrong.append(f"{at}.op")
        elif s["op"] in ("split", "rsplit"):
            wrong += [f"{at}.{k}" for k in ("delimiter", "targets") if not s.get(k)]
        else:
            wrong += [f"{at}.{k}" for k in ("target", *{"extract_between": ("start", "end"), "strip_prefix": ("literal",), "strip_suffix": ("literal",)}.get(s["op"], ())) if not s.get(k)]
    for f in profile.get("defaults") or {}:
        if f not in ROW_FIELDS:
            wrong.append(f"defaults.{f}")
    return wrong
