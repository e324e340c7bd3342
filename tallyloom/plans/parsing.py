"""The registered queries of the text readings, each with its SQL."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import functions as F

from tallyloom.operators import batch as B
from tallyloom.operators import drafts as T
from tallyloom.operators import fingerprint as P
from tallyloom.operators import parse as A
from tallyloom.operators import profiles as D
from tallyloom.operators import reading as G
from tallyloom.operators import tasks as K
from tallyloom.plans.registry import query
from tallyloom.plans.tables import cases, cases_sql, load, spread

#: Texts of every reading, with product, attributes, quantity, remark, status and review reason.
READ = [
    ("黑色, 42 新款甲 x2", "新款甲", "黑色", "42", 2, "", "draft", ""),
    ("新款透气跑步鞋甲 黑色/42", "新款透气跑步鞋甲", "黑色", "42", 1, "", "draft", ""),
    ("【春款】跑步鞋，黑色，42 *1", "【春款】跑步鞋", "黑色", "42", 1, "", "draft", ""),
    ("【春季】新款网面跑步鞋 黑白，41 x1", "【春季】新款网面跑步鞋", "黑白", "41", 1, "", "draft", ""),
    ("【春季】新款网面跑步鞋 黑白;41 x1", "【春季】新款网面跑步鞋", "黑白", "41", 1, "", "draft", ""),
    ("【春季】新款网面跑步鞋黑白\n41 x1", "【春季】新款网面跑步鞋", "黑白", "41", 1, "", "draft", ""),
    ("黑色 42\n【春】跑步鞋 *2", "春-跑步鞋", "黑色", "42", 2, "", "draft", ""),
    ("跑步鞋 *2\n颜色: 黑 尺码: 40", "跑步鞋", "黑", "40", 2, "", "draft", ""),
    ("新款透气跑步鞋甲 黑色/42 x3\n请尽快发货", "新款透气跑步鞋甲", "黑色", "42", 3, "请尽快发货", "draft", ""),
    ("透气黑 鞋码: 42", "", "透气黑", "42", 1, "", "draft", ""),
    ("【甲】黑色/42 *2", "甲", "黑色", "42", 2, "", "draft", ""),
    ("新款跑步鞋，黑（加绒，厚），42码 x1", "新款跑步鞋", "黑（加绒，厚）", "42", 1, "", "draft", ""),
    ("补差价 专用", "", "", "", None, "", "special", "price_gap"),
    ("鞋", "鞋", "鞋", "", None, "", "needs_review", "quantity"),
]


READ_COLUMNS = "product, sales_attr1, sales_attr2, quantity, remark, status, review_reason"


@query(cases_sql(READ_COLUMNS, [r[1:] for r in READ]))
def text_readings(spark, sf_dir):
    return A.parse_items(cases(spark, sf_dir, [r[0] for r in READ]), "item", keywords=[("补差价", "price_gap")]).select("p_partkey", *READ_COLUMNS.split(", "))


POLICY = {
    "label_cleanup": {"strip_prefixes": ["色", "色系"], "separator_chars": ["-", ":"]},
    "size_normalization": {"enabled": True, "strip_purchase_hint": False},
    "quantity": {"default_if_missing": 3},
    "manual_label_only": {"default_quantity_if_missing": 5, "allow_empty_product": False},
    "non_shoe": {"allow_non_numeric_sales_attr2": False},
}
POLICED = [
    ("甲", "甲", "甲", "", 3, "draft", ""),
    ("规格: 色系-黑", "", "黑", "", 5, "needs_review", "product"),
    ("新款透气跑步鞋甲 色:白/42（偏小） x2", "新款透气跑步鞋甲", "白", "42（偏小）", 2, "needs_review", "sales_attr2_non_numeric"),
    ("甲 乙，红，大 *1", "甲 乙", "红", "大", 1, "needs_review", "sales_attr2_non_numeric"),
]


@query(cases_sql("item, product, sales_attr1, sales_attr2, quantity, status, review_reason", POLICED))
def output_policy(spark, sf_dir):
    rows = cases(spark, sf_dir, [r[0] for r in POLICED])
    return A.parse_items(rows, "item", policy=POLICY).select("p_partkey", "item", "product", "sales_attr1", "sales_attr2", "quantity", "status", "review_reason")


@query("SELECT p_partkey, CAST(i AS INT) AS place, p_name || i || chr(10) || '颜色:' || p_brand || ' 尺码:' || (30 + i) AS item FROM part, (VALUES (0), (1)) t(i) WHERE p_size % 2 = 0")
def paired_items(spark, sf_dir):
    name = lambda i: F.concat("p_name", F.lit(str(i)))
    label = lambda i: F.concat(F.lit("颜色:"), "p_brand", F.lit(f" 尺码:{30 + i}"))
    text = F.when(F.col("p_size") % 2 == 0, F.array_join(F.array(name(0), name(1), label(0), label(1)), "\n")).otherwise(F.array_join(F.array(name(0), label(0), name(1), label(1)), "\r\n"))
    return spread(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.posexplode(A.paired_lines(text)).alias("place", "item"))


BRACKETS = [("甲，b(c,d)，e", "甲|b(c,d)|e", ""), ("x【甲,（z,w）,】,v;42", "x【甲,（z,w）,】|v;42", "x【甲,（z,w）,】,v|42"), ("),甲", ")|甲", ""), ("", "", ""), ("(a;41);甲", "(a;41);甲", ""), ("甲;(黑);38码", "甲;(黑);38码", "甲;(黑)|38码")]


@query(cases_sql("text, parts, size", BRACKETS))
def bracket_splits(spark, sf_dir):
    rows = cases(spark, sf_dir, [r[0] for r in BRACKETS], "text").withColumn("at", A.semicolon_size(F.col("text")))
    return rows.select("p_partkey", "text", F.array_join(A.comma_parts(F.col("text")), "|").alias("parts"), F.coalesce(F.concat("at.rest", F.lit("|"), "at.size"), F.lit("")).alias("size"))


@query("SELECT p_partkey, '新款透气跑步鞋' || p_brand AS product, CASE p_size % 3 WHEN 0 THEN '黑白' WHEN 1 THEN '低帮深卡其' ELSE '深灰色' END AS sales_attr1 FROM part")
def colour_suffixes(spark, sf_dir):
    third, product = F.col("p_size") % 3, F.concat(F.lit("新款透气跑步鞋"), "p_brand")
    line = F.when(third == 0, F.concat(product, F.lit("，黑白"))).when(third == 1, F.concat(product, F.lit("低帮深卡其"))).otherwise(F.concat(product, F.lit(" 颜色:深灰色")))
    got = A.attr1_suffix(line)
    return spread(spark, sf_dir, "part", "p_partkey").select("p_partkey", got["product"].alias("product"), got["sales_attr1"].alias("sales_attr1"))


LINES = [("甲/42", "甲", "42", "甲/42"), ("红甲 38.5", "红甲", "38.5", "红甲 38.5"), ("颜色:甲", "甲", "", "颜色:甲"), ("【新】甲，", "【新】甲", "", "新-甲"), ("【一二三四五六七八九】甲鞋，", "【一二三四五六七八九】甲鞋", "", "一二三四五六七八九】甲鞋")]


@query(cases_sql("text, product", [(r[0], r[3]) for r in LINES]))
def normalized_products(spark, sf_dir):
    rows = cases(spark, sf_dir, [r[0] for r in LINES], "text")
    return rows.select("p_partkey", "text", A.normalized_product(F.col("text")).alias("product"))


ATTRS = [("甲/42", "甲", "42"), ("红甲|38.5码", "红甲", "38.5"), ("颜色:甲，40 偏小", "甲", "40"), ("甲", "甲", ""), ("甲 42码", "甲", "42")]


@query(cases_sql("text, sales_attr1, sales_attr2", ATTRS))
def attribute_lines(spark, sf_dir):
    rows = cases(spark, sf_dir, [r[0] for r in ATTRS], "text").withColumn("got", A.simple_attrs(F.col("text")))
    return rows.select("p_partkey", "text", "got.sales_attr1", "got.sales_attr2")


#: Texts of one and more items, the items, and what sets them apart.
BOUNDED = [
    ("【甲】黑 42 1件；【甲】白 39 1件；【甲】黑 42 1件", "【甲】黑 42 1件|【甲】白 39 1件|【甲】黑 42 1件", "semicolon_repeated_title"),
    ("【甲】黑 42 *1【乙】白 39 *2", "【甲】黑 42 *1|【乙】白 39 *2", "repeated_title"),
    ("甲 黑 42 x1 / 甲 白 39 x2", "甲 黑 42 x1|甲 白 39 x2", "repeated_quantity"),
    ("甲 黑 42 x1 / 甲 白 39 x2 急件", "甲 黑 42 x1 / 甲 白 39 x2 急件", "single_item"),
    ("甲 黑 42；乙 39 1件；丙 2件 急", "甲 黑 42；乙 39 1件；丙 2件 急", "single_item"),
    ("甲；【乙】白", "甲|【乙】白", "semicolon"),
    ("甲 黑 42 x1\n2件", "甲 黑 42 x1", "newline_quantity_summary"),
    ("甲 黑\n乙 x1 丙 x2", "甲 黑|乙 x1|丙 x2", "newline+repeated_quantity"),
    ("甲 黑\r\n乙 白", "甲 黑|乙 白", "newline"),
    (" \n", "", "empty"),
]


@query(cases_sql("items, boundary", [r[1:] for r in BOUNDED]))
def item_boundaries(spark, sf_dir):
    rows = cases(spark, sf_dir, [r[0] for r in BOUNDED]).withColumn("got", A.boundary_items(F.col("item")))
    return rows.select("p_partkey", F.array_join("got.items", "|").alias("items"), "got.boundary")


#: Lines of samples, and the items that they make.
GROUPED = [
    ("甲 x2\n颜色: 黑 尺码: 40\n请尽快发货\n【新】甲，黑，41 *1\nauto", "甲 x2/颜色: 黑 尺码: 40/请尽快发货|【新】甲，黑，41 *1"),
    ("黑色，42\n甲 x1\n甲 x3\n白色/41\n甲 *1\n速发", "黑色，42/甲 x1|甲 x3|白色/41/甲 *1/速发"),
    ("甲一\n甲二\n颜色:黑\n颜色:白", "甲一/颜色:黑|甲二/颜色:白"),
    ("甲 *2\n颜色: 红 尺码: 40", "甲 *2/颜色: 红 尺码: 40"),
    ("xxx*1\n2件", ""),
]


@query(cases_sql("items", [r[1:] for r in GROUPED]))
def sample_groups(spark, sf_dir):
    rows = cases(spark, sf_dir, [r[0] for r in GROUPED])
    return rows.select("p_partkey", F.array_join(F.transform(A.candidate_texts(F.split("item", "\n")), lambda t: F.replace(t, F.lit("\n"), F.lit("/"))), "|").alias("items"))


# ---- profiles ----

PROFILES = [
    {"strategy": "structured_items_v1", "fingerprint": "A", "items_path": "data.items[]", "fields": {"product": "n", "quantity": "q"}},
    {"strategy": "text_pipeline_v1", "fingerprint": "B", "grammar": "g", "text_path": "text", "steps": [{"op": "split", "source": "text", "delimiter": "|", "targets": ["product", "quantity"]}, {"op": "to_positive_int", "source": "quantity", "target": "quantity"}], "field_roles": {"quantity": "positive_integer_quantity"}},
    {"strategy": "source_projection_v1", "fingerprint": "B", "grammar": "g", "text_path": "text", "rows": [{"product": ["delimiter_segment", 0, []], "quantity": ["positive_integer_quantity", 0, [{"op": "extract_quantity"}]]}]},
    {"strategy": "structured_items_v1", "fingerprint": "C", "items_path": "data.items[]", "fields": {"product": "n", "quantity": "q"}},
    {"strategy": "structured_items_v1", "fingerprint": "C", "items_path": "data.items[]", "fields": {"product": "q", "quantity": "q"}},
]
DOCS_SQL = "d AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS f, p_name AS n, p_brand AS b, p_size AS q FROM part)"


def profile_docs(spark, sf_dir):
    item = lambda name, q: F.struct(name.alias("n"), q.cast("string").alias("q"))
    payload = F.to_json(F.struct(F.struct(F.array(item(F.col("p_name"), F.col("p_size")), item(F.col("p_brand"), F.lit(2))).alias("items")).alias("data"), F.concat("p_name", F.lit("|"), "p_size", F.lit("件")).alias("text")))
    kind = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("p_size") % 4 + 1).cast("int"))
    return spread(spark, sf_dir, "part", "p_partkey").select("p_partkey", payload.alias("payload"), kind.alias("fingerprint"), F.lit("g").alias("grammar"))


@query(f"WITH {DOCS_SQL} SELECT p_partkey, CASE f WHEN 'A' THEN 'parsed' WHEN 'B' THEN 'parsed' WHEN 'C' THEN 'profile_ambiguous' ELSE 'format_profile_missing' END AS status, CASE f WHEN 'A' THEN 0 WHEN 'B' THEN 2 END AS position FROM d")
def profile_statuses(spark, sf_dir):
    return D.parse_profiles(profile_docs(spark, sf_dir), "p_partkey", PROFILES)[0]


@query(f"WITH {DOCS_SQL} SELECT p_partkey, 0 AS item, n AS product, CAST(q AS BIGINT) AS quantity, 'draft' AS row_status FROM d WHERE f IN ('A', 'B') UNION ALL SELECT p_partkey, 1, b, 2, 'draft' FROM d WHERE f = 'A'")
def profile_rows(spark, sf_dir):
    rows = D.parse_profiles(profile_docs(spark, sf_dir), "p_partkey", PROFILES)[1]
    return rows.select("p_partkey", F.coalesce(F.element_at("place", -1), F.lit(0)).alias("item"), "product", "quantity", F.col("status").alias("row_status"))


@query("SELECT count(*) FILTER (WHERE p_size % 3 > 0) AS passed, count(*) AS total, bool_and(p_size % 3 > 0) AS ok FROM part WHERE p_size % 4 = 0")
def profile_replay(spark, sf_dir):
    docs = profile_docs(spark, sf_dir)
    want = load(spark, sf_dir, "part").where("p_size % 4 = 0").select("p_partkey", F.array(F.concat("p_name", F.lit("|||"), "p_size", F.lit("|")), F.concat("p_brand", F.lit("|||"), F.when(F.col("p_size") % 3 > 0, "2").otherwise("9"), F.lit("|"))).alias("rows"))
    return K.replay_summary(D.replay_profile(docs, "p_partkey", PROFILES[0], want))


@query("SELECT p_partkey, 'v2:CN-PACKAGE-ITEMS:sha256:' || sha256('{\"fingerprint_code\":\"CN-PACKAGE-ITEMS\",\"shape\":{\"fields\":[' || CASE WHEN p_size % 2 = 0 THEN '[[\"n\",\"str\"],[\"q\",\"int\"]],' ELSE '' END || '[[\"n\",\"str\"],[\"q\",\"str\"]]]},\"source_component\":\"cainiao\"}') AS fingerprint FROM part")
def business_fingerprints(spark, sf_dir):
    text = lambda q: F.concat(F.lit('{"x":1,"n":"'), "p_name", F.lit('","q":'), q, F.lit("}"))
    items = F.array(text(F.concat(F.lit('"'), "p_size", F.lit('"'))), text(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise('"a"')))
    return spread(spark, sf_dir, "part", "p_partkey").select("p_partkey", P.business_fingerprint(F.lit("CN-PACKAGE-ITEMS"), F.lit(" CaiNiao"), F.transform(items, F.parse_json), ["q", "n", "absent"]).alias("fingerprint"))


# ---- fingerprints of nested payloads ----

#: The payloads' data objects by kind, as JSON with the event's props in it, and their formats and business shapes.
NESTED = [
    ('{"ITEM_INFO":"鞋 x1","SELLER_MEMO":"","extra":@}', "CN-ITEM-INFO", '{"fields":[[["ITEM_INFO","str"],["SELLER_MEMO","str"]]]}'),
    ('{"productInfo":"鞋","p":@},"printXML":"<a><text>一 二</text><text/></a>"', "CN-PRINT-XML", '{"fields":["printXML"]}'),
    ('{"customContent":[@],"ITEM_INFO":[]}', "CN-CUSTOM-CONTENT", '{"fields":[[["customContent","list"]]]}'),
    ('{"packageItemDetail":[{"itemName":"鞋","itemNum":1,"x":@},{"itemName":null,"skuSize":2.5},{"itemNum":7,"itemName":"帽"}]}', "CN-PACKAGE-ITEMS", '{"fields":[[["itemName","null"],["skuSize","float"]],[["itemName","str"],["itemNum","int"]]]}'),
    ('{"productInfo":@,"remark":true},"printXML":" "', "CLOUD-PRODUCT-INFO", '{"fields":[[["productInfo","dict"],["remark","bool"]]]}'),
    ('[@,@,1,null]', "UNKNOWN", '{"task":{"documents":{"items":[{"contents":{"items":[{"data":{"items":[{"k":{"type":"scalar"}},{"type":"scalar"},{"type":"null"}],"type":"list"}}],"type":"list"}}],"type":"list"}}}'),
]


def nested_payloads(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit('{"task":{"documents":[{"contents":[{"data":' + t + "}]}]}}") for t, _, _ in NESTED]), (F.col("event_id") % len(NESTED) + 1).cast("int"))
    return spread(spark, sf_dir, "events", "event_id").select("event_id", F.replace(kind, F.lit("@"), F.col("props")).alias("payload"), F.col("event_type").alias("component"))


NESTED_SQL = "n(i, code, shape) AS (VALUES " + ", ".join(f"({i}, '{c}', '{x}')" for i, (_, c, x) in enumerate(NESTED)) + ")"


@query(f"WITH {NESTED_SQL} SELECT event_id, code AS format_code, 'v2:' || code || ':sha256:' || sha256('{{\"fingerprint_code\":\"' || code || '\",\"shape\":' || shape || ',\"source_component\":\"' || lower(event_type) || '\"}}') AS fingerprint FROM events JOIN n ON event_id % {len(NESTED)} = i")
def fingerprint_dispatch(spark, sf_dir):
    return P.fingerprints(nested_payloads(spark, sf_dir), "payload", "component", "business_shape_v2").select("event_id", "format_code", "fingerprint")


@query(f"SELECT event_id, 'sha256:' || sha256('{{\"payload\":' || '{NESTED[5][2]}' || ',\"source_component\":\"' || lower(event_type) || '\"}}') AS fingerprint FROM events WHERE event_id % {len(NESTED)} = 5")
def structural_dispatch(spark, sf_dir):
    return P.fingerprints(nested_payloads(spark, sf_dir), "payload", "component").where("format_code = 'UNKNOWN'").select("event_id", "fingerprint")


@query(f"SELECT event_id, field, value FROM (SELECT event_id, event_id % {len(NESTED)} AS kind, replace(props, ' ', '') AS p FROM events), LATERAL (SELECT * FROM (VALUES (0, 'ITEM_INFO', '\"鞋 x1\"'), (0, 'SELLER_MEMO', ''), (0, 'BUYER_MEMO', ''), (0, 'ITEM_TOTAL_COUNT', ''), (1, 'printXML', '\"一 二\"'), (2, 'customContent', '[' || p || ']'), (3, 'itemName', '\"鞋\"/\"帽\"'), (3, 'simpleName', ''), (3, 'skuFullName', ''), (3, 'specName', ''), (3, 'specSimpleName', ''), (3, 'skuSize', '2.5'), (3, 'itemNum', '1/7'), (4, 'productInfo', p), (4, 'productShortInfo', ''), (4, 'sPInfo', ''), (4, 'sPSInfo', ''), (4, 'remark', 'true'), (4, 'buyerRemark', ''), (4, 'productCount', '')) v(i, field, value) WHERE i = kind)")
def inspected_fields(spark, sf_dir):
    return P.inspected(nested_payloads(spark, sf_dir), "payload").select("event_id", "field", F.array_join("values", "/").alias("value"))


# ---- batches ----

ITEM_SHAPE = '{"fingerprint_code":"CN-PACKAGE-ITEMS","shape":{"fields":[[["itemName","str"],["itemNum","str"]]]},"source_component":"cainiao"}'
PACK = {
    "code": "p", "name": "pack", "version": "1",
    "parser_policy": {
        "order_row_parser": "declarative_v1", "fingerprint_strategy": "business_shape_v2",
        "format_profiles": [{"strategy": "structured_items_v1", "fingerprint": "v2:CN-PACKAGE-ITEMS:sha256:" + sha256(ITEM_SHAPE.encode()).hexdigest(), "items_path": "task.documents[].contents[].data.packageItemDetail[]", "fields": {"product": "itemName", "quantity": "itemNum"}, "defaults": {"sales_attr1": "-", "sales_attr2": "-"}}],
    },
}
ITEM_DOC = '{"contents":[{"data":{"packageItemDetail":[{"itemName":"@","itemNum":"2"},{"itemName":"@ b","itemNum":"1"}]}}]}'
TEXT_DOC = '{"contents":[{"data":{"productInfo":"@，红，42 x2","other":1}}]}'
RECORDS = ['{"task":{"documents":[' + ITEM_DOC + "]}}", '{"task":{"documents":[' + ITEM_DOC + "," + TEXT_DOC + "]}}", '{"task":', '{"task":{"documents":[{},{}]}}', "[" * 30 + "]" * 30, '{"task":{"documents":[]},"x":1}']


def raw_records(spark, sf_dir):
    """All parts as records of twelve tasks: good, half good, broken, quarantined, too deep and unknown payloads."""
    kind = F.col("p_partkey") % len(RECORDS)
    payload = F.replace(F.element_at(F.array(*[F.lit(r) for r in RECORDS]), (kind + 1).cast("int")), F.lit("@"), F.col("p_name"))
    warning = F.when(kind == 3, "source_history_ambiguous")
    return spread(spark, sf_dir, "part", "p_partkey").select((F.col("p_partkey") % 12).alias("task_id"), F.col("p_partkey").alias("record_id"), F.lit("CaiNiao ").alias("component"), payload.alias("payload"), warning.alias("warning"))


RECORDS_SQL = "r AS (SELECT p_partkey % 12 AS task_id, p_partkey AS record_id, p_partkey % 6 AS kind, p_name FROM part)"


@query(f"WITH {RECORDS_SQL} SELECT task_id, record_id, CAST(0 AS BIGINT) AS document, i AS row_index, '面单 ' || record_id || '-子项 ' || i AS child_label, CASE i WHEN 1 THEN p_name ELSE p_name || ' b' END AS product, 3 - i AS quantity, 'draft' AS status FROM r, (SELECT unnest([1, 2]) AS i) WHERE kind < 2")
def batch_rows(spark, sf_dir):
    return B.parse_batch(raw_records(spark, sf_dir), PACK).rows.select("task_id", "record_id", "document", "row_index", "child_label", "product", "quantity", "status")


@query(f"WITH {RECORDS_SQL} SELECT task_id, record_id, CAST(i AS BIGINT) AS document, CASE WHEN kind = 1 AND i = 1 OR kind = 5 THEN 'format_profile_missing' WHEN kind = 2 THEN 'payload_not_json' WHEN kind = 3 THEN 'source_history_ambiguous' WHEN kind = 4 THEN 'payload_too_deep' END AS reason FROM r, (SELECT unnest([0, 1]) AS i) WHERE i = 0 OR kind IN (1, 3)")
def batch_diagnostics(spark, sf_dir):
    return B.parse_batch(raw_records(spark, sf_dir), PACK).diagnostics.select("task_id", "record_id", "document", "reason")


@query(f"WITH {RECORDS_SQL} SELECT task_id, CASE kind WHEN 0 THEN 'parsed' WHEN 3 THEN 'capture_source_exception' WHEN 2 THEN 'format_profile_incomplete' WHEN 4 THEN 'format_profile_incomplete' ELSE 'format_profile_missing' END AS parse_status, count(*) * CASE WHEN kind IN (1, 3) THEN 2 ELSE 1 END AS parent_count, count(*) * CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS unresolved_count, count(*) * CASE WHEN kind < 2 THEN 2 ELSE 0 END AS child_count FROM r GROUP BY task_id, kind")
def batch_statuses(spark, sf_dir):
    return B.parse_batch(raw_records(spark, sf_dir), PACK).status


@query(f"WITH {RECORDS_SQL} SELECT task_id, record_id, CAST(i AS BIGINT) AS document, CASE WHEN kind = 1 AND i = 1 THEN p_name ELSE '' END AS product, CASE WHEN kind = 1 AND i = 1 THEN CAST(2 AS BIGINT) END AS quantity, CASE WHEN kind = 1 AND i = 1 THEN '' ELSE 'no_readable_waybill_text' END AS review_reason FROM r, (SELECT unnest([0, 1]) AS i) WHERE kind = 1 AND i = 1 OR kind = 5 AND i = 0")
def batch_text_rows(spark, sf_dir):
    pack = PACK | {"parser_policy": {"format_profiles": []}}
    rows = B.parse_batch(raw_records(spark, sf_dir), pack).rows
    return rows.where(F.col("product").isin("") | F.col("sales_attr1").isin("红")).select("task_id", "record_id", "document", "product", "quantity", "review_reason")


# ---- samples ----

SAMPLES_SQL = "e AS (SELECT event_id, user_id, event_id % 3 AS kind, event_type AS t FROM events), s AS (SELECT event_id, 0 AS pos, CASE kind WHEN 1 THEN 'fallback' ELSE 'read' END AS state, CASE kind WHEN 1 THEN [{'path': 'product', 'text': '红鞋 ' || t}] WHEN 0 THEN [{'path': 'task.documents[0].data.product', 'text': '红鞋,' || t}, {'path': 'task.documents[0].printXML.text[0]', 'text': '第一' || t}, {'path': 'task.documents[0].printXML.text[1]', 'text': '第二'}] ELSE [] END AS texts FROM e UNION ALL SELECT event_id, 1, 'read', [] FROM e WHERE kind = 0)"


def samples(spark, sf_dir):
    kind, t = F.col("event_id") % 3, F.col("event_type")
    doc = F.concat(F.lit('{"task":{"documents":[{"data":{"product":"红鞋,'), t, F.lit('"},"printXML":"<a><text><![CDATA[第一'), t, F.lit(']]></text><text>第二</text></a>"},{"rowid":"7"}]}}'))
    payload = F.when(kind == 0, doc).when(kind == 1, F.concat(F.lit('{"product":"红鞋 '), t, F.lit('"}'))).otherwise("no JSON")
    rows = spread(spark, sf_dir, "events", "event_id").select("event_id", payload.alias("payload"), F.when(F.col("user_id") % 2 == 0, " memo").otherwise("").alias("memo"))
    return G.reading_samples(rows, "event_id", "payload", ["memo"])


@query(f"WITH {SAMPLES_SQL} SELECT event_id, CAST(pos AS INT) AS document_pos, CAST(len(texts) + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_texts, CASE WHEN len(texts) = 0 AND user_id % 2 <> 0 THEN 'empty' WHEN kind = 2 THEN 'fallback' ELSE state END AS state FROM s JOIN e USING (event_id)")
def reading_samples(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", F.col("document_pos").cast("int").alias("document_pos"), F.size("texts").cast("bigint").alias("n_texts"), "state")


@query(f"WITH {SAMPLES_SQL}, x AS (SELECT event_id, pos, unnest(texts) AS x FROM s UNION ALL SELECT s.event_id, pos, {{'path': 'record.memo', 'text': 'memo'}} FROM s JOIN e USING (event_id) WHERE user_id % 2 = 0) SELECT event_id, CAST(pos + 1 AS BIGINT) AS sample_number, x.path AS source_path, x.text AS line, CAST(0 AS BIGINT) AS start, CAST(length(x.text) AS BIGINT) AS end, replace(x.text, ',', '|') AS segments FROM x")
def sample_blocks(spark, sf_dir):
    return G.sample_blocks(samples(spark, sf_dir), "event_id").select("event_id", "sample_number", "source_path", "line", "start", "end", F.array_join("segments", "|").alias("segments"))


AREAS = [
    ('<page><layout id="CUSTOM_AREA"><text>甲<b>b</b></text></layout><text>c</text></page>', "甲b+|c-"),
    ("<x><text>1</text></x><custom-area><y><text><![CDATA[<2>]]></text></y></custom-area><text>3 &amp; 4</text>", "1-|<2>+|3 & 4-"),
    ("<r><!-- <text>no</text> --><ns:text k='v'>甲</ns:text><text/></r>", "甲-"),
    ("甲", None),
]


@query(cases_sql("xml, texts", AREAS))
def xml_area_texts(spark, sf_dir):
    rows = cases(spark, sf_dir, [x for x, _ in AREAS], "xml")
    shown = F.transform(G.area_texts(F.col("xml")), lambda t: F.concat(t["text"], F.when(t["marked"], "+").otherwise("-")))
    return rows.select("p_partkey", "xml", F.array_join(shown, "|").alias("texts"))


# ---- drafts ----

DRAFT_SQL = "d AS (SELECT p_partkey, p_size % 4 AS kind, p_name AS n, p_size AS q FROM part)"


@query(f"WITH {DRAFT_SQL} SELECT p_partkey, CAST(1 AS INT) AS row_index, CASE kind WHEN 0 THEN n WHEN 1 THEN n || 'a' ELSE '' END AS product, CASE kind WHEN 0 THEN CAST(2 AS BIGINT) WHEN 1 THEN CAST(1 AS BIGINT) END AS quantity, CASE WHEN kind < 2 THEN 'draft' ELSE 'needs_review' END AS status, CASE kind WHEN 2 THEN 'no_readable_waybill_text' WHEN 3 THEN 'no_product_text' ELSE '' END AS review_reason FROM d UNION ALL SELECT p_partkey, 2, n || 'b', 1, 'draft', '' FROM d WHERE kind = 1")
def draft_rows(spark, sf_dir):
    kind = F.col("p_size") % 4
    two = F.concat(F.col("p_name"), F.lit(" *2\n颜色: 红 尺码: 40"))
    four = F.concat(F.col("p_name"), F.lit("a\n"), F.col("p_name"), F.lit("b\n颜色:黑\n颜色:白"))
    parents = spread(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.when(kind == 0, two).when(kind == 1, four).when(kind == 2, " ").otherwise("auto").alias("text"))
    return T.draft_rows(parents, "p_partkey", "text").select("p_partkey", F.col("row_index").cast("int").alias("row_index"), "product", "quantity", "status", "review_reason")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'a.productInfo' WHEN p_size % 3 = 1 THEN 'x.printXML.text[0]' ELSE 'other' END AS path, CASE WHEN p_size % 3 = 2 THEN CAST(1 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS n FROM part")
def preferred_texts(spark, sf_dir):
    third = F.col("p_size") % 3
    paths = F.when(third == 0, F.array(F.lit("x.printXML.text[0]"), F.lit("a.productInfo"), F.lit("a.productInfo"))).when(third == 1, F.array(F.lit("other"), F.lit("x.printXML.text[0]"), F.lit("x.printXML.text[0]"), F.lit("x.printXML.text[1]"))).otherwise(F.array(F.lit("other")))
    blocks = load(spark, sf_dir, "part").select("p_partkey", F.posexplode(paths).alias("place", "path"))
    return T.preferred_texts(blocks, ["p_partkey"], "path", ["place"]).groupBy("p_partkey", "path").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(i AS INT) AS document, 'source_history_ambiguous' AS reason, 0 AS child_count FROM orders, LATERAL (SELECT unnest(range(1, greatest(o_orderkey % 3, 1) + 1)) AS i) WHERE o_orderstatus = 'P'")
def quarantined_parents(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "source_history_ambiguous").otherwise(" ").alias("warning"), (F.col("o_orderkey") % 3).alias("n"))
    return T.quarantined(rows, "o_orderkey", "warning", "n").withColumn("document", F.col("document").cast("int"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || '/short/' || p_size || '|' || p_brand || '//3' ELSE p_name || '/short/' || p_size || '|' || p_brand || '//-' END AS items, CASE WHEN p_size % 2 = 0 THEN CAST(p_size + 3 AS BIGINT) WHEN p_size % 3 = 0 THEN CAST(7 AS BIGINT) END AS total FROM part")
def zipped_items(spark, sf_dir):
    even = F.col("p_size") % 2 == 0
    counts = F.concat(F.col("p_size").cast("string"), F.when(even, F.lit("\n3件")).otherwise("\nmany"))
    items = T.zipped_items(F.concat("p_name", F.lit("\n"), "p_brand"), F.lit("short"), counts)
    rows = load(spark, sf_dir, "part").select("p_partkey", items.alias("items"), F.when(~even & (F.col("p_size") % 3 == 0), "共7件").otherwise("").alias("stated"))
    shown = F.array_join(F.transform("items", lambda i: F.concat_ws("/", i["product"], i["short"], F.coalesce(i["quantity"].cast("string"), F.lit("-")))), "|")
    return rows.select("p_partkey", shown.alias("items"), T.total_quantity(F.col("stated"), F.col("items")).alias("total"))


@query("SELECT p_partkey, left(sha1('{\"brand\":' || (p_size % 2 = 0) || ',\"name\":true}'), 12) AS structure FROM part")
def structure_keys(spark, sf_dir):
    brand = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return load(spark, sf_dir, "part").select("p_partkey", T.structure_key({"name": F.col("p_name"), "brand": brand}).alias("structure"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS product FROM part")
def content_texts(spark, sf_dir):
    values = F.create_map(F.lit("short"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" "), F.lit("full"), F.col("p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", T.first_of_keys(values, ["missing", "short", "full"]).alias("product"))
