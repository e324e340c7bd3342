"""Matching rows to products, SKUs, images and stalls by administrators' rules, with an explicit status for every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import firsts, match_text, once, plain, positive_int, runs

FIELDS = ("product", "sales_attr1", "sales_attr2", "quantity", "remark")
# Every status that a row can have; image_unmatched is listed though nothing gives it.
STATUSES = ("conflict", "image_unmatched", "matched", "pending", "product_unmatched", "sku_ambiguous", "sku_unmatched", "special")
#: Rules that are folded into the plan as expressions; more are joined by keyword.
MOST_FOLDED = 200


def five_fields(rows: DataFrame, mapping: dict[str, str | Column]) -> DataFrame:
    """The five fields as trimmed text, null as empty, beside the columns that rows has."""
    return rows.withColumns({f: plain(F.col(mapping[f]) if isinstance(mapping.get(f), str) else mapping[f]) if f in mapping else F.lit("") for f in FIELDS})


def normalized_rule(rule: dict) -> dict:
    """A rule with defaults: keyword or field values, match type, targets and priority."""
    kinds = ("exact", "contains")
    product_type = next((t for t in (rule.get("product_match_type"), rule.get("match_type")) if t), "contains")
    product_type = product_type if product_type in kinds else "contains"
    match_type = rule.get("match_type") if rule.get("match_type") in kinds else product_type
    fields = [f for f in dict.fromkeys(rule.get("product_match_fields") or rule.get("match_fields") or []) if f in FIELDS]
    ident = lambda v: v if isinstance(v, int) and v > 0 else None
    return {
        "id": ident(rule.get("id")),
        "fields": fields,
        "keyword": (rule.get("product_keyword") or "").strip(),
        "values": rule.get("field_values") or {},
        "product_match_type": product_type,
        "match_type": match_type,
        "sku_match_fields": list(rule.get("sku_match_fields") or []),
        "product_id": ident(rule.get("product_id")),
        "sku_id": ident(rule.get("sku_id")),
        "image_id": ident(rule.get("image_asset_id")),
        "priority": ident(rule.get("priority")) or 100,
        "enabled": rule.get("is_enabled") is not False,
    }


def _compare(actual: Column, expected: str, kind: str) -> Column:
    want = expected.strip().lower().translate({32: None, 9: None, 10: None})
    if not want:
        return F.lit(False)
    return actual.contains(want) if kind == "contains" else actual == want


def rule_condition(rule: dict, actual: dict[str, Column]) -> Column:
    """Keyword rules match in any of their fields; rules with field values must match in all."""
    if not rule["enabled"] or not rule["fields"]:
        return F.lit(False)
    if rule["keyword"]:
        return reduce(lambda a, b: a | b, [_compare(actual[f], rule["keyword"], rule["product_match_type"]) for f in rule["fields"]])
    return reduce(lambda a, b: a & b, [_compare(actual[f], str(rule["values"].get(f) or ""), rule["match_type"]) for f in rule["fields"]])


def _hit(rule: dict) -> Column:
    return F.struct(
        F.lit(rule["priority"]).cast("int").alias("priority"),
        F.lit(rule["id"]).cast("bigint").alias("rule_id"),
        F.lit(rule["product_id"]).cast("bigint").alias("product_id"),
        F.lit(rule["sku_id"]).cast("bigint").alias("sku_id"),
        F.lit(rule["image_id"]).cast("bigint").alias("image_id"),
    )


def rule_hits(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """rows with hits: the rules that match, by priority, then id. No join: the rules are part of the plan."""
    ordered = sorted((normalized_rule(r) for r in rules), key=lambda r: (r["priority"], r["id"] or 0))
    if len(ordered) > MOST_FOLDED:
        raise ValueError(f"{len(ordered)} rules: use rule_hits_joined() for more than {MOST_FOLDED}")
    # only fields that rules look at are brought to their compared form, and both steps are computed once for each row
    used = [f for f in FIELDS if any(f in r["fields"] for r in ordered if r["enabled"])]
    if not used:
        return rows.withColumn("hits", F.array().cast("array<struct<priority:int,rule_id:bigint,product_id:bigint,sku_id:bigint,image_id:bigint>>"))
    keyed = once(rows, "__fields", F.struct(*[match_text(F.col(f)).alias(f) for f in used]))
    actual = {f: F.col(f"__fields.{f}") for f in used}
    return once(keyed, "hits", F.array_compact(F.array(*[F.when(rule_condition(r, actual), _hit(r)) for r in ordered if r["enabled"]]))).drop("__fields")


def rule_hits_joined(rows: DataFrame, rules: DataFrame, row_id: str) -> DataFrame:
    """(row_id, hits) for any number of keyword rules (id, field, keyword, kind, priority, product_id, sku_id, image_id; a row for each field).

    Rules are matched with the distinct values of each field, not with rows. Exact rules join on the value. Contained keywords join
    on their first three characters (or fewer) with the values' runs of as many, then are verified: the plan has equi-joins only."""
    values = rows.select(row_id, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), match_text(F.col(f)).alias("value")) for f in FIELDS])).alias("v")).select(row_id, "v.*").where("value != ''")
    each = values.select("field", "value").distinct()
    want = rules.withColumn("keyword", match_text(F.col("keyword"))).where("keyword != ''")
    hit = F.struct("priority", F.col("id").alias("rule_id"), "product_id", "sku_id", "image_id").alias("hit")
    exact = each.join(want.where("kind = 'exact'").withColumnRenamed("keyword", "value"), ["field", "value"])
    part = want.where("kind != 'exact'").withColumn("gram", firsts(F.col("keyword")))
    some = each.withColumn("gram", F.explode(runs(F.col("value")))).join(part, ["field", "gram"]).where(F.col("value").contains(F.col("keyword")))
    both = exact.select("field", "value", hit).unionByName(some.select("field", "value", hit)).groupBy("field", "value").agg(F.collect_set("hit").alias("found"))
    return values.join(both, ["field", "value"]).groupBy(row_id).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("hits"))


def match_status(rows: DataFrame, status_col: str = "parse_status") -> DataFrame:
    """rows of rule_hits() with match_status and rule: special and pending rows first, then no hit, several targets, or `hit`."""
    targets = F.array_distinct(F.transform("hits", lambda h: F.struct(h["product_id"], h["sku_id"], h["image_id"])))
    parse = F.lower(plain(F.col(status_col))) if status_col in rows.columns else F.lit("")
    status = F.when(parse == "special", "special").when((parse != "") & (parse != "draft"), "pending").when(F.size("hits") == 0, "product_unmatched").when(F.size(targets) > 1, "conflict").otherwise("hit")
    found = once(rows, "match_status", status)
    return found.withColumn("rule", F.when(F.col("match_status").isin("conflict", "hit"), F.col("hits")[0]))


def sku_scores(rows: DataFrame, skus: DataFrame, row_id: list[str], fields: list[str]) -> DataFrame:
    """The best score of each SKU (product_id, sku_id, terms) that can be a row's best (rows: row_id, product_id and the fields).

    All is done on the distinct values of each product, then joined with the rows. Equal terms are found by equi-join. Only
    values of rows without one, for which lower scores count, are compared by containment: the contained text's first characters
    have to be among the runs of the other, which makes that an equi-join too, and no product's terms meet all its values."""
    return _sku_scores(rows.select(*row_id, "product_id", F.explode(F.array_distinct(F.array(*[match_text(F.col(f)) for f in fields]))).alias("value")).where("value != ''"), skus, row_id)


def _sku_scores(value: DataFrame, skus: DataFrame, row_id: list[str]) -> DataFrame:
    """sku_scores() of values (row_id, product_id, value)."""
    term = skus.select("product_id", "sku_id", F.explode(F.array_distinct(F.transform("terms", match_text))).alias("term")).where("term != ''")
    equal = value.join(term.withColumnRenamed("term", "value"), ["product_id", "value"]).groupBy(*row_id, "product_id", "sku_id").agg((F.max(F.length("value")) + 10000).alias("score"))
    rest = value.join(equal.select(*row_id).distinct(), row_id, "left_anti")
    v, t = rest.select("product_id", "value").distinct(), term.select("product_id", "term").distinct()
    gram = lambda df, c, f: df.withColumn("gram", F.explode(f(F.col(c))) if f is runs else f(F.col(c)))
    holds = gram(v, "value", runs).join(gram(t, "term", firsts), ["product_id", "gram"]).where(F.col("value").contains(F.col("term"))).withColumn("score", F.length("term") + 5000)
    held = gram(v, "value", firsts).join(gram(t, "term", runs), ["product_id", "gram"]).where(F.col("term").contains(F.col("value"))).withColumn("score", F.length("value") + 1000)
    pairs = holds.unionByName(held).groupBy("product_id", "value", "term").agg(F.max("score").alias("score"))
    best = pairs.join(term, ["product_id", "term"]).groupBy("product_id", "value", "sku_id").agg(F.max("score").alias("score"))
    inside = rest.join(best, ["product_id", "value"]).groupBy(*row_id, "product_id", "sku_id").agg(F.max("score").alias("score"))
    return equal.unionByName(inside)


def top_sku(scores: DataFrame, row_id: list[str]) -> DataFrame:
    """The single SKU of the highest score, or none where several have it (n_best)."""
    each = scores.groupBy(*row_id, "score").agg(F.count("*").alias("n_best"), F.max("sku_id").alias("sku"))
    best = each.groupBy(*row_id).agg(F.max(F.struct("score", "n_best", "sku")).alias("m"))
    return best.select(*row_id, F.col("m.score").alias("score"), F.col("m.n_best").alias("n_best"), F.when(F.col("m.n_best") == 1, F.col("m.sku")).alias("sku_id"))


def best_sku(rows: DataFrame, skus: DataFrame, row_id: list[str], fields: list[str]) -> DataFrame:
    """top_sku() of sku_scores() of the rows; rows without a score are left out.

    What is compared are the distinct sets of values, not the rows, so that the scores of all SKUs don't grow with the rows."""
    value = F.array_distinct(F.array(*[match_text(F.col(f)) for f in fields]))
    held = rows.select(*row_id, F.transform(value, lambda v: F.struct(F.col("product_id").alias("product_id"), v.alias("value"))).alias("own"))
    held = held.groupBy(*row_id).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("__held"))  # one row's values
    scores = _sku_scores(held.select("__held").distinct().select("__held", F.explode("__held").alias("v")).select("__held", "v.*").where("value != ''"), skus, ["__held"])
    return held.hint("merge").join(top_sku(scores, ["__held"]), "__held").drop("__held")  # rows are never broadcast, however small their files


def linked(rows: DataFrame, products: DataFrame, skus: DataFrame, images: DataFrame, sku_fields: list[str], row_id: str = "row_index") -> DataFrame:
    """Resolves the rows of match_status() that hit: product, explicit or best SKU, image and stall.

    products: product_id, product_name, stall_id, stall_name. skus: sku_id, product_id, sku_name, terms, image_id, stall_id,
    stall_name. images: image_id, image_name. A missing image leaves a row matched; an explicit SKU that is absent is not guessed."""
    hit = rows.withColumns({"product_id": F.col("rule.product_id"), "want_sku": F.col("rule.sku_id"), "want_image": F.col("rule.image_id")})
    p = products.select("product_id", "product_name", F.col("stall_id").alias("p_stall_id"), F.col("stall_name").alias("p_stall_name"))
    auto = hit.where((F.col("match_status") == "hit") & F.col("want_sku").isNull())
    best = best_sku(auto, skus.select("product_id", "sku_id", "terms"), [row_id], sku_fields).select(row_id, F.col("sku_id").alias("auto_sku"), "n_best")
    s = skus.select(F.col("sku_id").alias("use_sku"), F.col("product_id").alias("sku_product"), "sku_name", F.col("image_id").alias("sku_image"), F.col("stall_id").alias("s_stall_id"), F.col("stall_name").alias("s_stall_name"))
    out = hit.join(p, "product_id", "left").join(best, row_id, "left")
    out = out.withColumn("use_sku", F.coalesce("want_sku", "auto_sku")).join(s, "use_sku", "left")
    final = (
        F.when(F.col("match_status") != "hit", F.col("match_status"))
        .when(F.col("product_name").isNull(), "product_unmatched")
        .when(F.col("want_sku").isNull() & (F.coalesce("n_best", F.lit(0)) > 1), "sku_ambiguous")
        .when(F.col("sku_product").isNull(), "sku_unmatched")
        .when(F.col("sku_product") != F.col("product_id"), "conflict")
        .otherwise("matched")
    )
    out = out.withColumn("match_status", final).withColumn("image_id", F.when(F.col("match_status") == "matched", F.coalesce("want_image", "sku_image")))
    out = out.join(images.select("image_id", "image_name"), "image_id", "left")
    some = positive_int(F.col("s_stall_id"))
    return out.withColumns({"stall_id": F.coalesce(some, positive_int(F.col("p_stall_id"))), "stall_name": F.coalesce(F.nullif(plain(F.col("s_stall_name")), F.lit("")), F.nullif(plain(F.col("p_stall_name")), F.lit("")))})


def status_summary(rows: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """A row for each status, with 0 where there is none, and one for the total."""
    dim = F.explode(F.array(*[F.lit(s) for s in (*statuses, "total")])).alias("match_status")
    seen = rows.groupBy("match_status").agg(F.count("*").alias("n"))
    counted = seen.unionByName(seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("match_status"), "n"))
    return rows.sparkSession.range(1).select(dim).join(counted, "match_status", "left").select("match_status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def rule_preview(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """For each rule: rows matched and in conflict with exactly its target, and the rows that no rule took."""
    target = F.struct(*[F.coalesce(F.col(f"rule.{c}"), F.lit(-1)).alias(c) for c in ("product_id", "sku_id", "image_id")])
    live = rows.where("match_status != 'special'").groupBy(target.alias("t"), F.col("rule").isNull().alias("none")).agg(F.count_if(F.col("match_status") == "conflict").alias("c"), F.count_if(F.col("match_status").isin("matched", "hit")).alias("m"), F.count("*").alias("n"))
    spec = [normalized_rule(r) for r in rules]
    dim = F.explode(F.array(*[F.struct(F.lit(r["id"]).cast("bigint").alias("rule_id"), F.lit(r["product_id"] or -1).cast("bigint").alias("p"), F.lit(r["sku_id"] or -1).cast("bigint").alias("s"), F.lit(r["image_id"] or -1).cast("bigint").alias("i")) for r in spec])).alias("d")
    each = rows.sparkSession.range(1).select(dim).select("d.*")
    # both sides are a few rows: the rules, and the counts of each target
    same = ~F.col("none") & (F.col("p") == F.col("t.product_id")) & (F.col("s") == F.col("t.sku_id")) & (F.col("i") == F.col("t.image_id"))
    total = lambda c, n: F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0))
    return each.join(live, F.lit(True), "left").groupBy("rule_id").agg(total(same, "m").alias("matched_count"), total(same, "c").alias("conflict_count"), total(F.col("none"), "n").alias("unmatched_count"))


def status_samples(rows: DataFrame, order: list[str], limit: int = 5) -> DataFrame:
    """The first rows of each status; the rank filter also prunes before the shuffle."""
    w = Window.partitionBy("match_status").orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
