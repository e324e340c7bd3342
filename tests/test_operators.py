"""Operators on small rows made by hand."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import coverage as C
from tallyloom.operators import fingerprint as P
from tallyloom.operators import match as M
from tallyloom.operators import parse as A
from tallyloom.operators import reading as R
from tallyloom.operators import records as S
from tallyloom.operators import report as L
from tallyloom.operators import rules as U


def values(spark, texts, column):
    rows = [(i, t) for i, t in enumerate(texts)]
    return [r.v for r in spark.createDataFrame(rows, "i int, t string").select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_quantities(spark):
    texts = ["鞋 *2", "鞋 x 3", "4双", "鞋 【5】", "12", "abcx2", "鞋*0", None, "", "*2a"]
    assert values(spark, texts, X.quantity_from_text) == [2, 3, 4, 5, 12, None, None, None, None, None]


def test_trailing_quantity(spark):
    got = values(spark, ["鞋 黑 *2", "鞋 2件；", "鞋"], lambda c: X.strip_trailing_quantity(c, order=True))
    assert [tuple(g) for g in got] == [("鞋 黑", "2"), ("鞋", "2"), ("鞋", "")]


def test_sizes_and_labels(spark):
    assert values(spark, ["42码", "鞋码: 38.5", "42 运单号: AB123", "均码", "41（偏大）"], X.normalize_size) == ["42", "38.5", "42", "均码", "41"]
    assert values(spark, ["颜色: 黑 颜色: 白"], X.remove_field_label) == ["黑 颜色: 白"]


def test_report_quantity_and_cells(spark):
    assert values(spark, ["2", "*3件", "x", "", "0"], lambda c: X.report_quantity(c, F.lit(1))) == [2, 3, 1, 1, 1]
    assert values(spark, ["=1", " +2", "a-b", None], X.safe_cell) == ["'=1", "' +2", "a-b", None]


def test_parents_and_labels(spark):
    assert values(spark, ["面单 7", "第1批-第12单", "x"], lambda c: X.parent_sequence(F.lit(None), c)) == [7, 12, None]
    assert values(spark, ["3-9", "8", "a"], lambda c: X.parent_label(c, F.lit(5), F.lit(None).cast("int"))) == ["面单 9", "面单 8", "面单 5"]
    assert values(spark, ["SKU图/SKU图_1_黑 42.jpg"], X.sku_name_from_file) == ["黑 42"]


RULES = [
    {"id": 1, "product_keyword": "ring", "product_match_fields": ["product"], "product_id": 1, "priority": 2},
    {"id": 2, "product_keyword": "red", "product_match_fields": ["product", "remark"], "product_id": 2, "priority": 1},
    {"id": 3, "match_fields": ["product", "sales_attr1"], "field_values": {"product": "bolt", "sales_attr1": "M4"}, "match_type": "exact", "product_id": 3, "sku_id": 30},
    {"id": 4, "product_keyword": "ring", "product_match_fields": ["product"], "product_id": 1, "priority": 9},
]


def order_rows(spark):
    data = [(1, "Ring", "a", "", "1", "", ""), (2, "red ring", "a", "", "1", "", "draft"), (3, "Bolt", "m 4", "", "1", "", ""), (4, "x", "", "", "", "", "needs_review"), (5, "x", "", "", "", "", "special"), (6, "nut", None, None, None, None, None)]
    return spark.createDataFrame(data, "row_index long, product string, sales_attr1 string, sales_attr2 string, quantity string, remark string, parse_status string")


def test_match_status(spark):
    rows = M.match_status(M.rule_hits(order_rows(spark), RULES))
    got = {r.row_index: (r.match_status, r.rule and r.rule.rule_id) for r in rows.collect()}
    # equal targets are no conflict; priority does not settle one
    assert got == {1: ("hit", 1), 2: ("conflict", 2), 3: ("hit", 3), 4: ("pending", None), 5: ("special", None), 6: ("product_unmatched", None)}
    summary = {r.match_status: r.n for r in M.status_summary(rows.replace("hit", "matched", "match_status")).collect()}
    assert summary["total"] == 6 and summary["matched"] == 2 and summary["image_unmatched"] == 0


def test_linked(spark):
    rows = M.match_status(M.rule_hits(order_rows(spark), RULES))
    products = spark.createDataFrame([(1, "Ring", 5, "North"), (3, "Bolt", None, None)], "product_id long, product_name string, stall_id long, stall_name string")
    skus = spark.createDataFrame([(10, 1, "a", ["a"], 7, None, None), (11, 1, "ab", ["ab"], None, 6, ""), (30, 9, "m", ["m"], None, None, None)], "sku_id long, product_id long, sku_name string, terms array<string>, image_id long, stall_id long, stall_name string")
    images = spark.createDataFrame([(8, "other")], "image_id long, image_name string")
    got = {r.row_index: (r.match_status, r.use_sku, r.image_name, r.stall_id, r.stall_name) for r in M.linked(rows, products, skus, images, ["sales_attr1"]).collect()}
    assert got[1] == ("matched", 10, None, 5, "North")  # the missing image leaves it matched
    assert got[3][0] == "conflict"  # the SKU is of another product
    assert got[6][0] == "product_unmatched"


def test_joined_rules_find_what_folded_ones_find(spark):
    rows = order_rows(spark)
    rules = spark.createDataFrame([(1, "product", "ri", "contains", 1, 1, None, None), (2, "product", "Red Ring", "exact", 2, 2, None, None), (3, "remark", "z", "contains", 3, 3, None, None)], "id long, field string, keyword string, kind string, priority int, product_id long, sku_id long, image_id long")
    got = {r.row_index: [h.rule_id for h in r.hits] for r in M.rule_hits_joined(rows, rules, "row_index").collect()}
    assert got == {1: [1], 2: [1, 2]}


def line(i, **more):
    base = {"i": i, "status": "matched", "product_id": 1, "product_name": "P", "stall_id": 1, "stall_name": "S", "sku_id": None, "image_id": None, "sales_attr1": "black", "sales_attr2": "42", "quantity": "1", "remark": "", "image_match_text": "t", "item_count": 1}
    return base | more


def report(spark, lines, **options):
    schema = "i int, status string, product_id long, product_name string, stall_id long, stall_name string, sku_id long, image_id long, sales_attr1 string, sales_attr2 string, quantity string, remark string, image_match_text string, item_count int"
    df = spark.createDataFrame([tuple(x.values()) for x in lines], schema)
    return L.natural_order(L.stacked(L.line_items(df), ["i"], **options)).collect()


def test_stacked_report(spark):
    lines = [line(1, quantity="2", remark="b"), line(2, sales_attr2="9", remark="a"), line(3, remark="b"), line(4, quantity="", item_count=2, sales_attr2="40"), line(5, status="pending"), line(6, stall_id=None, stall_name=" ")]
    first, second = report(spark, lines)
    assert (first.size_text, first.quantity, first.remark) == ("9 40 42 42 42", 4, "b\na")
    assert second.stall_name == "未设置档口"
    assert report(spark, lines, stack_sizes=True)[0].size_text == "9 40 42"
    assert report(spark, []) == []


def test_layout():
    layout = L.normalized_layout('{"columns": [{"key": "quantity", "label": " n ", "width": 9999}, {"key": "x"}, {"key": "quantity"}], "stack_sales_attr2": 1}')
    assert [c["key"] for c in layout["columns"]][:2] == ["quantity", "product_name"] and layout["columns"][0] == {"key": "quantity", "label": "n", "visible": True, "width": 600}
    assert L.normalized_layout("{")["columns"][0]["key"] == "product_name"
    hidden = L.normalized_layout({"columns": [{"key": k, "visible": False} for k in L.COLUMNS]})
    assert sum(c["visible"] for c in hidden["columns"]) == 1


def cover(spark, expected, rows):
    e = spark.createDataFrame(expected, "raw_record_id long, parent_sequence long")
    r = spark.createDataFrame(rows, "raw_record_id long, parent_sequence long, status string, product_id long, product_name string, product_text string, sales_attr1_text string, sales_attr2_text string, quantity_text string, remark_text string, exception string")
    return C.coverage(e, r)


def row(raw, seq, status="matched", text="p", exception=""):
    return (raw, seq, status, 1, "n", text, "", "", "1", "", exception)


def test_coverage_passes_and_keeps_equal_rows(spark):
    report = cover(spark, [(1, 1), (2, 1)], [row(1, 1), row(1, 1), row(2, 1, "pending", exception="why")]).first()
    assert report.ok and report.covered_parent_count == 2 and [(w.code, w.n) for w in report.warnings] == [("duplicate_child_rows", 1)]


def test_coverage_fails_on_identity_even_with_equal_counts(spark):
    df = cover(spark, [(1, 1), (2, 1), (2, 1), (None, 1)], [row(1, 1), row(3, 1), row(4, None), row(5, 1, "pending")])
    found = {f.code: f.n for f in df.first().failures}
    assert found == {"expected_parent_trace_missing": 1, "expected_parent_identity_collision": 1, "parent_count_mismatch": 1, "raw_record_uncovered": 1, "source_trace_missing": 1, "exception_not_actionable": 1, "parent_partition_incomplete": 2}
    with pytest.raises(Exception, match="coverage is not complete"):
        C.require_complete(df, spark.range(3)).collect()
    assert C.require_complete(cover(spark, [(1, 1)], [row(1, 1)]), spark.range(3)).count() == 3


def test_segments_and_xml(spark):
    assert values(spark, ["a，b；c *2", "颜色:黑/白 42", "鞋子 XL", "", None], R.segments) == [["a", "b", "c", "*2"], ["颜色:黑/白", "42"], ["鞋子", "XL"], [], []]
    assert values(spark, ["<text a='1'><![CDATA[x]]></text><TEXT>a &amp;lt; <b>b</b></TEXT>", "<p><![CDATA[only]]></p>", "none"], R.xml_texts) == [["x", "a &lt; b"], ["only"], []]


def test_leaves_documents_and_filters(spark):
    df = spark.createDataFrame([(1, '{"b": {"x": [1, true, null, " "]}, "a": 1.0, "a": 2.0}'), (2, "no json"), (3, None)], "i int, p string")
    assert [(r.i, r.path, r.text) for r in R.walk_leaves(df, "p").orderBy("i", "leaf_order").collect()] == [(1, "b.x[0]", "1"), (1, "b.x[1]", "True"), (1, "a", "2.0")]
    docs = spark.createDataFrame([('{"task": {"documents": [{"documentID": "d1"}, {"documentID": "d2"}]}}',), ("{}",)], "p string")
    got = R.payload_documents(docs, "p").collect()
    assert [r.document_pos for r in got] == [0, 1, 0]
    reasons = spark.createDataFrame([("a.rowid", "x"), ("a.my_token", "x"), ("items[0].remark", "1234"), ("items[0].qty", "1234"), ("z", "颜色"), ("z", "x"), ("z", "123")], "p string, t string").select(R.field_filter_reason(F.col("p"), F.col("t")).alias("r"))
    assert [r.r for r in reasons.collect()] == ["technical_field_name", "technical_field_path", "technical_value", None, None, "not_business_relevant", "not_business_relevant"]


def test_fingerprints(spark):
    a = spark.createDataFrame([('{"b": [1, 2], "a": "x"}', "C "), ('{"a": "y", "b": [3]}', "c"), ('{"a": {}}', "c"), ("[1]", "c")], "p string, c string")
    got = [r.f for r in a.select(P.structural_fingerprint(F.col("p"), F.col("c"), 4).alias("f")).collect()]
    assert got[0] == got[1] != got[2] and got[3] is None
    exact = values(spark, ["①鞋，红 ２双！", "1鞋，红 2双!"], lambda c: P.grammar_signature(F.array(c, c)))
    assert exact[0] == exact[1] and exact[0] != values(spark, ["x"], lambda c: P.grammar_signature(F.array(c)))[0]
    one = values(spark, ["鞋，红 2双!", "袜，蓝 9双!", "袜 蓝"], lambda c: P.grammar_signature(F.array(c), exact=False))
    assert one[0] == one[1] != one[2]


def test_rule_steps(spark):
    rows = spark.createDataFrame([("a-b-c", "x【t】y", " 7 ")], "s string, u string, n string")
    steps = [{"op": "rsplit", "source": "text", "delimiter": "-", "targets": ["product", "sales_attr1"]}, {"op": "extract_between", "source": "u", "target": "sales_attr2", "start": "【", "end": "】", "consume": True}, {"op": "strip_suffix", "source": "u", "target": "remark", "literal": "y"}, {"op": "to_positive_int", "source": "n", "target": "quantity"}]
    r = U.run_steps(rows, {"text": F.col("s"), "u": F.col("u"), "n": F.col("n")}, steps).first()
    assert (r.product, r.sales_attr1, r.sales_attr2, r.remark, r.quantity, r.status) == ("a-b", "c", "t", "x", 7, "draft")
    assert U.validation_errors({"strategy": "text_pipeline_v1", "fingerprint": "f", "steps": [{"op": "eval"}, {"op": "split"}], "defaults": {"z": 1}}) == ["text_path", "steps[0].op", "steps[1].delimiter", "steps[1].targets", "defaults.z"]


def test_parse_items(spark):
    texts = ["【跑鞋】黑色/42 *2", "新款跑步鞋，黑，42码 x1", "颜色: 黑 鞋码: 42", "鞋", "补差价 专用", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.product, r.sales_attr1, r.sales_attr2, r.quantity, r.status, r.review_reason) for r in A.parse_items(df, "t", keywords=[("补差价", "price_gap")]).collect()}
    assert got[0] == ("跑鞋", "黑色", "42", 2, "draft", "")
    assert got[1] == ("新款跑步鞋", "黑", "42", 1, "draft", "")
    assert got[2] == ("", "黑", "42", 1, "draft", "")
    assert got[3] == ("鞋", "鞋", "", None, "needs_review", "quantity")
    assert got[4][4:] == ("special", "price_gap")
    assert got[5][4:] == ("needs_review", "product,quantity")


def test_equal_children_stay(spark):
    df = spark.createDataFrame([(1, "A *1\nB *1\nA *1")], "i int, t string")
    assert [r.v for r in df.select(F.explode(A.split_items(F.col("t"))).alias("v")).collect()] == ["A *1", "B *1", "A *1"]


def test_hash_chain_and_multisets(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "g int, i int, c string")
    got = {r.g: (r.n, r.chain) for r in S.hash_chain(df, "g", ["i"], F.col("c"), 1).collect()}
    assert got[1] == (2, None) and got[2][0] == 1 and len(got[2][1]) == 64
    assert S.multiset_difference(df.select("c"), df.select("c")).count() == 0


def test_evidence_spans(spark):
    from tallyloom.operators import evidence as V

    df = spark.createDataFrame([("p[0].a", "红 鞋，42 *２双\n7"), ("p[0].b", None), ("p[1].a", " ")], "p string, t string")
    found = V.spans(df, F.col("p"), "t").orderBy("p", "span_order")
    got = [(r.token_class, r.start, r.end, r.original_text) for r in found.collect()]
    assert got == [
        ("text", 0, 10, "红 鞋，42 *２双"),
        ("delimiter_segment", 0, 3, "红 鞋"),
        ("positive_integer_quantity", 8, 9, "２"),
        ("shoe_size_like_numeric_segment", 4, 6, "42"),
        ("text", 11, 12, "7"),
        ("positive_integer_quantity", 11, 12, "7"),
    ]
    df2 = spark.createDataFrame([("a[0].t", "x2 件, y/37；12"), ("a[1].t", "３８.5|12\r\n 9 "), ("b", "12 3\n12 3\n5件 6件"), ("c", "12x3 *4个a")], "p string, t string")
    got2 = sorted((r.p, r.span_order, r.token_class, r.original_text) for r in V.spans(df2, F.col("p"), "t").collect() if r.token_class != "text")
    assert [(p, c[:4], t) for p, _, c, t in got2] == [("a[0].t", "deli", "y"), ("a[0].t", "posi", "2"), ("a[0].t", "shoe", "37"), ("a[1].t", "shoe", "３８.5"), ("a[1].t", "posi", "9"), ("b", "posi", "5"), ("b", "posi", "6"), ("c", "posi", "3"), ("c", "posi", "4")]
    kinds = {}
    for r in V.grouped_spans(V.spans(df2, F.col("p"), "t"), [], ["a"]).collect():
        kinds.setdefault(r.kind, []).append((r.group_path, len(r.span_ids)))
    assert sorted(kinds["structured_list_item"]) == [("a[0]", 1), ("a[1]", 2)]
    assert sorted(kinds["repeated_line_or_array_group"]) == [("a", 3), ("b", 2), ("b", 2), ("c", 2)] and len(kinds["line"]) == 7
    tests = [("红", "text", True), (" ", "text", False), ("12", "positive_integer_quantity", True), ("012", "positive_integer_quantity", False), (" ４２.5", "shoe_size_like_numeric_segment", True), ("60", "shoe_size_like_numeric_segment", False), ("a/b", "delimiter_segment", False), ("x", "other", False), (None, "text", False)]
    judged = spark.createDataFrame(tests, "v string, c string, want boolean").select("want", V.matches_class(F.col("v"), F.col("c")).alias("got")).collect()
    assert all(r.want == r.got for r in judged)
    groups = V.candidate_groups(found, []).collect()
    assert [(g.item_path, len(g.span_ids)) for g in groups] == [("p[0]", 6)]
    assert all(r.span_id.startswith("span-") and len(r.span_id) == 25 for r in found.collect())


def test_values_at_path(spark):
    from tallyloom.operators import evidence as V

    df = spark.createDataFrame([(1, '{"task": {"documents": [{"a": {"x": "1"}}, {"a": {"x": null}}, {"b": 2}]}}'), (2, "{}"), (3, None)], "i int, p string")
    got = V.values_at_path(df, "p", "task.documents[].a.x").orderBy("value_path").collect()
    assert [(r.i, r.value_path, r.value) for r in got] == [(1, "task.documents[0].a.x", "1"), (1, "task.documents[1].a.x", None)]


def test_rule_packs_are_judged_before_use():
    from tallyloom.operators import drafts

    good = {"strategy": "structured_items_v1", "fingerprint": "f", "items_path": "a[]", "fields": {"product": "n"}}
    pack = {"code": "c", "name": "n", "version": "1", "parser_policy": {"format_profiles": [good, good, {"strategy": "other"}, 7], "colour": {}}}
    errors, warnings = drafts.pack_findings(pack)
    assert errors == ["parser_policy.format_profiles[2].strategy", "parser_policy.format_profiles[3].profile"]
    assert len(warnings) == 2 and drafts.pack_findings({}) == (["code", "name", "version", "parser_policy"], [])


def test_repeated_titles_become_children(spark):
    from tallyloom.operators import drafts as T

    title = "【登山鞋涉水鞋防水机能户外徒步男鞋女鞋休闲防滑溯溪越野鞋跑步鞋】"
    df = spark.createDataFrame([(1, f"{title}低帮黑白 42 1件；{title}低帮深卡其 39 1件；{title}低帮黑白 42 1件"), (2, f"{title}4.0灰蓝 42.5 1件"), (3, None), (4, " \n")], "i int, t string")
    got = T.draft_rows(df, "i", "t").orderBy("i", "row_index").collect()
    assert [(r.i, r.sales_attr1, r.sales_attr2, r.quantity, r.remark, r.status) for r in got if r.i < 3] == [(1, "低帮黑白", "42", 1, "", "draft"), (1, "低帮深卡其", "39", 1, "", "draft"), (1, "低帮黑白", "42", 1, "", "draft"), (2, "4.0灰蓝", "42.5", 1, "", "draft")]
    assert {r.product for r in got if r.i < 3} == {title.strip("【】")}
    assert [(r.i, r.status, r.review_reason) for r in got if r.i > 2] == [(3, "needs_review", "no_readable_waybill_text"), (4, "needs_review", "no_readable_waybill_text")]


def test_candidate_texts_take_every_line_once():
    from tallyloom.operators import readings as R

    lines = ["甲鞋 x2", "颜色: 黑 尺码: 40", "请发顺丰"] * 400 + ["乙 x1"] * 50
    got = R.candidate_texts(lines)
    assert [t for g in got for t in g.split("\n")] == lines
    assert got[:2] == ["甲鞋 x2\n颜色: 黑 尺码: 40\n请发顺丰"] * 2 and got[-1] == "乙 x1"
    assert R.candidate_texts(None) == R.candidate_texts(["", " ", "auto", "xxx*1"]) == []


def test_parser_plans_are_small(spark):
    df = spark.createDataFrame([(1, "甲鞋 x2")], "i int, t string")
    for policy in (None, {"quantity": {"default_if_missing": 1}, "label_cleanup": {"strip_prefixes": ["色"]}}):
        plan = A.parse_items(df, "t", keywords=[("补差价", "price_gap")], policy=policy)._jdf.queryExecution().executedPlan().toString()
        assert len(plan) < 20_000
