"""The registered queries of the task, scope, learning, summary and export operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import records as S
from tallyloom.operators import tasks as K
from tallyloom.plans.registry import query
from tallyloom.plans.tables import load

ZERO = "TIMESTAMP '2024-01-10 00:00:00'"


@query(f"WITH e AS (SELECT user_id, event_id, CASE WHEN value >= 0.5 THEN ts END AS t FROM events), s AS (SELECT user_id, min(event_id) FILTER (WHERE t IS NULL OR t >= {ZERO}) AS stop FROM e GROUP BY 1) SELECT user_id, CAST(coalesce(max(event_id) FILTER (WHERE stop IS NULL OR event_id < stop), 0) AS BIGINT) AS cursor FROM e JOIN s USING (user_id) GROUP BY user_id")
def initial_cursor(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("t", F.when(F.col("value") >= 0.5, F.col("ts")))
    return K.initial_cursor(e, ["user_id"], "event_id", "t", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


TASKS_SQL = "t AS (SELECT s_nationkey AS k, s_suppkey AS task_id, CASE WHEN s_suppkey % 5 = 0 THEN 'active' ELSE 'completed' END AS status, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (s_suppkey * 7 % 500) AS start, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (s_suppkey * 7 % 500 + s_suppkey % 60) AS stop FROM supplier), p AS (SELECT n_nationkey AS k, n_nationkey % 4 AS n_rows, CASE WHEN n_nationkey % 3 > 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (n_nationkey * 13 % 400) END AS first, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (n_nationkey * 13 % 400 + 50) AS last FROM nation)"


@query(f"WITH {TASKS_SQL}, f AS (SELECT t.k, task_id FROM t JOIN p USING (k) WHERE status = 'active' UNION SELECT t.k, task_id FROM t JOIN p USING (k) WHERE status = 'completed' AND n_rows > 0 AND first IS NOT NULL AND start <= last + INTERVAL 1 SECOND AND stop >= first UNION SELECT t.k, max(task_id) FROM t JOIN p USING (k) WHERE status = 'completed' AND n_rows > 0 AND first IS NULL GROUP BY 1) SELECT f.k, f.task_id, n_rows <= 0 OR first IS NOT NULL AS covered FROM f JOIN p USING (k)")
def overlapping_tasks(spark, sf_dir):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    hours = lambda c: base + F.make_dt_interval(F.lit(0), c.cast("int"))
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    start = F.col("s_suppkey") * 7 % 500
    tasks = s.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("task_id"), F.when(F.col("s_suppkey") % 5 == 0, "active").otherwise("completed").alias("status"), hours(start).alias("start"), hours(start + F.col("s_suppkey") % 60).alias("end"))
    at = F.col("n_nationkey") * 13 % 400
    pending = n.select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 4).alias("n_rows"), F.when(F.col("n_nationkey") % 3 > 0, hours(at)).alias("first"), hours(at + 50).alias("last"))
    return K.overlapping_tasks(tasks, pending, "k")


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'take' WHEN value >= 1 AND user_id % 2 = 0 THEN 'skip' ELSE 'stop' END AS step FROM events")
def uncovered_rows(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return K.uncovered(e, F.when(F.col("value") >= 1, F.col("ts")), F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0).select("event_id", "step")


@query("SELECT 'orders' AS level, o_orderkey AS id, CAST(0 AS BIGINT) AS line FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'lines', l_orderkey, CAST(l_linenumber AS BIGINT) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')")
def archive_cascade(spark, sf_dir):
    roots = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    orders, lines = K.archive_cascade(roots, [(load(spark, sf_dir, "orders"), "o_orderkey", "o_custkey"), (load(spark, sf_dir, "lineitem"), "l_orderkey", "l_orderkey")], "c_custkey")
    level = lambda df, name, key, line: df.select(F.lit(name).alias("level"), F.col(key).alias("id"), line.cast("bigint").alias("line"))
    return level(orders, "orders", "o_orderkey", F.lit(0)).unionByName(level(lines, "lines", "l_orderkey", F.col("l_linenumber")))


@query("SELECT event_id, (SELECT count(*) FROM events WHERE event_type = 'click') AS total, (SELECT count(*) FROM events WHERE event_type = 'click') > 25 AS has_more FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 20 OFFSET 5")
def counted_page(spark, sf_dir):
    rows = load(spark, sf_dir, "events").where("event_type = 'click'")
    return K.counted_page(rows, [F.col("event_id")], 5, 20).select("event_id", "total", "has_more")


@query("SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) = 7")
def details_of_task(spark, sf_dir):
    return K.of_task(load(spark, sf_dir, "events"), "props", 7, "$.k").select("event_id")


@query("SELECT event_id FROM (SELECT * FROM events ORDER BY event_id LIMIT 2000) WHERE user_id % 7 = 3")
def scope_limit_first(spark, sf_dir):
    return K.first_of_scope(load(spark, sf_dir, "events"), "event_id", 2000, F.col("user_id") % 7 == 3).select("event_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) AS place FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def selected_first(spark, sf_dir):
    ids = load(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    orders = load(spark, sf_dir, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_orderstatus")
    return K.selected_first(orders, orders.select("o_orderkey"), "o_orderkey", F.col("o_orderstatus") == "F").select("o_orderkey", "place")


@query("SELECT conv_id, rn AS place, u.text AS said, a.text AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user') u JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'assistant') a USING (conv_id, rn)")
def positional_zip(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    side = lambda role, name: S.number_parents(c.where(F.col("role") == role), "conv_id", ["turn"], "place").select("conv_id", "place", F.col("text").alias(name))
    return K.zipped(side("user", "said"), side("assistant", "answer"), ["conv_id"], "place")


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_duplicate_wins(spark, sf_dir):
    return S.last_of_each(load(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text").select("conv_id", "text")


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(chr(10), p_name, p_brand, p_type, CAST(p_size AS VARCHAR))), 'brand#1')")
def table_search(spark, sf_dir):
    return K.search_all(load(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type", "p_size"], " BRAND#1").select("p_partkey")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id DESC LIMIT 80)")
def newest_groups(spark, sf_dir):
    return K.newest_groups(load(spark, sf_dir, "events"), "user_id", 80).select("event_id", "user_id")


@query("SELECT coalesce(max(CASE WHEN o_orderkey = 17 THEN o_orderkey END), max(o_orderkey)) AS o_orderkey FROM orders UNION ALL SELECT coalesce(max(CASE WHEN o_orderkey = -1 THEN o_orderkey END), max(o_orderkey)) FROM orders")
def round_selection(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return K.chosen_or_newest(orders, "o_orderkey", 17).unionByName(K.chosen_or_newest(orders, "o_orderkey", -1))


@query("SELECT s_suppkey, CASE WHEN n_nationkey % 5 = 0 OR n_nationkey > 20 THEN 'nation ' || s_nationkey ELSE n_name END AS n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def label_with_fallback(spark, sf_dir):
    n = load(spark, sf_dir, "nation").where("n_nationkey <= 20").select(F.col("n_nationkey").alias("s_nationkey"), F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.col("n_name")).alias("n_name"))
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return K.with_label(s, n, "s_nationkey", "n_name", F.concat(F.lit("nation "), "s_nationkey")).select("s_suppkey", "n_name")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN '抖店打印组件' WHEN 'signup' THEN '菜鸟打印组件' WHEN 'view' THEN '-' ELSE event_type END AS label FROM events")
def component_labels(spark, sf_dir):
    code = F.when(F.col("event_type") == "click", "cloud-print-client").when(F.col("event_type") == "signup", " cainiao-cnprint").when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))
    return load(spark, sf_dir, "events").select("event_id", K.component_label(code).alias("label"))


@query("SELECT p_partkey FROM part WHERE p_size IN (SELECT p_size FROM part WHERE p_partkey % 50 = 0)")
def image_semi_join(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return part.join(part.where("p_partkey % 50 = 0").select("p_size").distinct(), "p_size", "left_semi").select("p_partkey")


@query("SELECT l_orderkey AS raw, l_linenumber AS doc, l_partkey AS parent, CASE WHEN ps.p_size > 25 THEN 'reason ' || ps.p_size END AS reason, o_orderpriority AS label FROM lineitem LEFT JOIN part ps ON ps.p_partkey = l_partkey AND ps.p_size > 25 LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'O'")
def learning_queue(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("raw"), F.col("l_linenumber").alias("doc"), F.col("l_partkey").alias("parent"))
    part = load(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("parent"), F.concat(F.lit("reason "), "p_size").alias("reason"))
    diagnostics = lines.distinct().join(part, "parent")
    parents = lines.select("raw", "parent").distinct().join(load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("raw"), F.col("o_orderpriority").alias("label")), "raw")
    return K.learning_queue(lines, diagnostics, parents, "raw", "doc", "parent").select("raw", "doc", "parent", "reason", "label")


@query("SELECT DISTINCT l_orderkey AS task FROM lineitem JOIN part ON l_partkey = p_partkey WHERE (p_brand = 'Brand#7' AND p_type = 'PROMO') OR p_brand = 'Brand#9'")
def affected_tasks(spark, sf_dir):
    lines, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    samples = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("task"), F.col("p_brand").alias("fingerprint"), F.col("p_type").alias("grammar"))
    of = spark.createDataFrame([("Brand#7", "PROMO"), ("Brand#9", None)], "fingerprint string, grammar string")
    return K.same_format(samples, "task", "fingerprint", "grammar", of)


@query("SELECT DISTINCT p_brand, CASE WHEN p_brand IN ('Brand#1', 'Brand#3') THEN 'own' WHEN p_brand < 'Brand#2' THEN 'usual' END AS fields FROM part")
def field_selections(spark, sf_dir):
    prints = load(spark, sf_dir, "part").select("p_brand").distinct()
    own = spark.createDataFrame([("Brand#1", "own"), ("Brand#3", "own")], "p_brand string, fields string")
    return K.field_selection(prints, own, prints.where("p_brand < 'Brand#2'").withColumn("fields", F.lit("usual")), "p_brand")


@query("SELECT o_custkey AS workspace, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id, max(o_orderdate) AS updated_at FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def active_packs(spark, sf_dir):
    packs = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("workspace"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"), (F.col("o_orderstatus") != "F").alias("is_active"))
    return K.active_pack(packs, "workspace")


@query("WITH p AS (SELECT p_brand AS fingerprint, CASE WHEN p_size % 2 = 0 THEN 'structured_items_v1' ELSE 'text_pipeline_v1' END AS strategy, p_type AS fields, p_name AS grammar, max(p_size) AS revision FROM part WHERE p_size <= 25 GROUP BY 1, 2, 3, 4), n AS (SELECT DISTINCT p_brand AS fingerprint, CASE WHEN p_size % 2 = 0 THEN 'structured_items_v1' ELSE 'text_pipeline_v1' END AS strategy, p_type AS fields, p_name AS grammar FROM part WHERE p_size > 25), m AS (SELECT fingerprint, max(revision) AS last FROM p GROUP BY 1) SELECT fingerprint, strategy, fields, grammar, revision FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE (n.fingerprint, n.strategy, n.fields) = (p.fingerprint, p.strategy, p.fields) AND (p.strategy = 'structured_items_v1' OR n.grammar = p.grammar)) UNION ALL SELECT n.*, coalesce(last, 0) + 1 FROM n LEFT JOIN m USING (fingerprint)")
def revised_profiles(spark, sf_dir):
    part = load(spark, sf_dir, "part").withColumn("strategy", F.when(F.col("p_size") % 2 == 0, "structured_items_v1").otherwise("text_pipeline_v1"))
    named = part.select(F.col("p_brand").alias("fingerprint"), "strategy", F.col("p_type").alias("fields"), F.col("p_name").alias("grammar"), "p_size")
    old = named.where("p_size <= 25").groupBy("fingerprint", "strategy", "fields", "grammar").agg(F.max("p_size").alias("revision"))
    new = named.where("p_size > 25").drop("p_size").distinct().withColumn("revision", F.lit(None).cast("int"))
    return K.revised(old, new).withColumn("revision", F.col("revision").cast("int"))


@query("SELECT count(*) FILTER (WHERE conv_id % 3 <> 1) AS passed, count(*) AS total, bool_and(conv_id % 3 <> 1) AS ok FROM (SELECT DISTINCT conv_id FROM conversations)")
def replay_summary(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("place"), F.col("text").alias("value"))
    want = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("rows"))
    want = want.withColumn("rows", F.when(F.col("conv_id") % 3 == 1, F.concat("rows", F.array(F.lit("more")))).otherwise(F.col("rows")))
    return K.replay_summary(K.replay(c, ["conv_id"], want))


@query("SELECT conv_id, bool_and((role = 'user') = (turn % 2 = 0)) AS roles_match FROM conversations GROUP BY conv_id")
def field_roles(spark, sf_dir):
    return K.roles_match(load(spark, sf_dir, "conversations"), ["conv_id"], F.col("role") == "user", F.col("turn") % 2 == 0)


@query("WITH d AS (SELECT o_custkey AS batch, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 7 = 0 THEN 'format_profile_missing' WHEN o_orderkey % 2 = 0 THEN 'timestamp_invalid_fallback' WHEN o_custkey % 4 = 0 THEN 'missing_product' END AS reason FROM orders) SELECT batch, CASE WHEN bool_or(coalesce(reason, '') = 'format_profile_missing') THEN 'format_profile_missing' WHEN count(reason) = 0 THEN 'parsed' WHEN count(reason) = count(*) FILTER (WHERE reason = 'timestamp_invalid_fallback') THEN 'capture_source_exception' ELSE 'format_profile_incomplete' END AS parse_status FROM d GROUP BY batch")
def batch_status(spark, sf_dir):
    key = F.col("o_orderkey")
    reason = F.when((F.col("o_orderstatus") == "O") & (key % 7 == 0), "format_profile_missing").when(key % 2 == 0, "timestamp_invalid_fallback").when(F.col("o_custkey") % 4 == 0, "missing_product")
    return K.batch_status(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), reason.alias("reason")), ["batch"], "reason")


@query("WITH r AS (SELECT l_suppkey AS task, l_orderkey AS parent, CASE l_returnflag WHEN 'A' THEN 'draft' WHEN 'N' THEN 'needs_review' ELSE 'special' END AS s, 1 AS c FROM lineitem UNION ALL SELECT l_suppkey, -l_orderkey, 'needs_review', 0 FROM lineitem WHERE l_linenumber = 7) SELECT task, count(DISTINCT parent) AS parent_waybill_count, CAST(sum(c) AS BIGINT) AS child_waybill_count, count(*) FILTER (WHERE s = 'draft') AS draft_count, count(*) FILTER (WHERE s = 'needs_review') AS needs_review_count, count(*) FILTER (WHERE s = 'special') AS special_count FROM r GROUP BY task")
def draft_summary(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "draft").when(F.col("l_returnflag") == "N", "needs_review").otherwise("special")
    rows = lines.select(F.col("l_suppkey").alias("task"), F.col("l_orderkey").alias("parent"), status.alias("status"))
    return K.draft_summary(rows, ["task"], "parent", "status", lines.where("l_linenumber = 7").select(F.col("l_suppkey").alias("task"), (-F.col("l_orderkey")).alias("parent")))


@query("SELECT l_suppkey, CASE WHEN count(DISTINCT CASE WHEN l_suppkey % 10 > 0 THEN l_orderkey END) = 0 THEN count(*) ELSE count(DISTINCT CASE WHEN l_suppkey % 10 > 0 THEN l_orderkey END) END AS n_waybills FROM lineitem GROUP BY l_suppkey")
def waybill_counts(spark, sf_dir):
    parent = X.parent_label(F.lit(""), F.col("l_orderkey"), F.lit(0))
    label = F.when(F.col("l_suppkey") % 10 > 0, X.child_label(F.concat(F.lit("面单 "), F.col("l_orderkey").cast("string")), F.col("l_linenumber"), F.lit(2)))
    return K.waybill_count(load(spark, sf_dir, "lineitem").select("l_suppkey", label.alias("label"), parent.alias("parent")), ["l_suppkey"], "label")


@query("WITH s AS (SELECT l_suppkey AS scope, CASE WHEN l_returnflag = 'A' THEN 'order_row_draft' WHEN l_returnflag = 'N' THEN 'detail' END AS t, l_orderkey AS rec, CASE WHEN l_returnflag = 'N' THEN l_partkey END AS detail FROM lineitem), b AS (SELECT scope, count(DISTINCT CASE WHEN t = 'order_row_draft' THEN rec END) AS parents, count(DISTINCT detail) AS details, count(*) FILTER (WHERE t = 'detail') AS a, count(*) FILTER (WHERE t = 'order_row_draft') AS o, count(*) FILTER (WHERE t IS NULL) AS u FROM s GROUP BY scope) SELECT scope, CASE WHEN parents > 0 THEN parents ELSE details END AS covered, details, '{' || concat_ws(',', CASE WHEN a > 0 THEN '\"detail\":' || a END, CASE WHEN o > 0 THEN '\"order_row_draft\":' || o END, CASE WHEN u > 0 THEN '\"unknown\":' || u END) || '}' AS source_types, greatest(40 - CASE WHEN parents > 0 THEN parents ELSE details END, 0) AS missing FROM b")
def scope_coverage(spark, sf_dir):
    flag = F.col("l_returnflag")
    sources = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scope"), F.when(flag == "A", "order_row_draft").when(flag == "N", "detail").alias("source_type"), F.lit(None).cast("string").alias("parent_label"), F.col("l_orderkey").alias("record_id"), F.when(flag == "N", F.col("l_partkey")).alias("detail_id"))
    return K.scope_coverage(sources, ["scope"], sources.select("scope").distinct().withColumn("total", F.lit(40).cast("bigint")))


@query("WITH e AS (SELECT o_custkey AS task, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1), r AS (SELECT o_custkey AS task, count(DISTINCT l_orderkey) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY 1) SELECT task, CASE WHEN task % 9 > 0 THEN n END AS expected, CASE WHEN task % 9 > 0 THEN coalesce(m, 0) END AS recognised, CASE WHEN task % 9 > 0 THEN n - coalesce(m, 0) END AS lost, CASE WHEN task % 9 = 0 THEN 'failed' END AS error FROM e LEFT JOIN r USING (task)")
def task_scan(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("parent"))
    lines = load(spark, sf_dir, "lineitem").where("l_returnflag != 'R'").select(F.col("l_orderkey").alias("parent"))
    failed = orders.where("task % 9 = 0").select("task", F.lit("failed").alias("error")).distinct()
    return K.scan_tasks(orders, lines.join(orders, "parent"), "task", "parent", failed)


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'signup') AS n_signup, count(*) FILTER (WHERE event_type NOT IN ('click', 'signup')) AS n_other, count(*) AS n FROM events GROUP BY user_id")
def source_histogram(spark, sf_dir):
    return K.conditional_counts(load(spark, sf_dir, "events"), ["user_id"], "event_type", ["click", "signup"])


@query("WITH b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '未设置档口' WHEN s_suppkey % 3 = 1 THEN 'a_b and a name that is much longer than sheets allow' ELSE s_name END AS base FROM supplier), n AS (SELECT *, left(base, 31) AS cut, row_number() OVER (PARTITION BY left(base, 31) ORDER BY s_suppkey) AS k FROM b) SELECT s_suppkey, CASE WHEN k = 1 THEN cut ELSE left(base, CAST(31 - length('_' || k) AS BIGINT)) || '_' || k END AS title FROM n")
def sheet_titles(spark, sf_dir):
    third = F.col("s_suppkey") % 3
    names = load(spark, sf_dir, "supplier").select("s_suppkey", F.when(third == 0, " ").when(third == 1, "'a:b and a name that is much longer than sheets allow").otherwise(F.col("s_name")).alias("name"))
    return K.sheet_titles(names, "name", "s_suppkey").select("s_suppkey", "title")


@query("SELECT o_orderkey, 'a_b_' || strftime(o_orderdate + INTERVAL 8 HOUR, '%Y%m%d_%H%M%S') || '.csv' AS name FROM orders")
def file_names(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", K.file_name(F.lit(" a/b "), "csv", F.col("o_orderdate")).alias("name"))


@query("SELECT doc_id, CASE WHEN length(text) <= 160 THEN text ELSE rtrim(left(text, 160)) || '...' END AS preview FROM documents")
def text_previews(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", K.preview(F.col("text")).alias("preview"))


@query("SELECT p_partkey, p_type AS \"类型\", p_name AS \"商品\", '' AS \"空\" FROM part")
def defined_columns(spark, sf_dir):
    values = F.create_map(F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))
    define = lambda i, f, label, order, on=True: {"id": i, "field": f, "label": label, "order": order, "enabled": on}
    rows = load(spark, sf_dir, "part").select("p_partkey", K.allowed_values(values, ["name", "type"]).alias("v"))
    return K.defined_columns(rows, "v", [define(1, "name", "商品", 2), define(2, "brand", "品牌", 0), define(3, "type", "类型", 1), define(4, "brand", "空", 2), define(5, "name", "名", 1, False)], ["p_partkey"])


@query("SELECT p_partkey, CAST(i AS INT) AS item_index, CASE WHEN p_size % 3 = 0 OR p_size % 3 = 1 AND p_size % 2 = 0 THEN 'total' WHEN p_size % 3 = 1 THEN '7' WHEN i = 1 THEN '2' ELSE '' END AS item_quantity FROM part, LATERAL (SELECT unnest(range(1, greatest(p_size % 3, 1) + 1)) AS i)")
def detail_export_rows(spark, sf_dir):
    item = lambda q: F.struct(q.alias("quantity"), F.col("p_name").alias("product"))
    third, one = F.col("p_size") % 3, F.when(F.col("p_size") % 2 == 0, F.lit(None).cast("string")).otherwise("7")
    items = F.when(third == 1, F.array(item(one))).when(third == 2, F.array(item(F.lit("2")), item(F.lit(" "))))
    rows = load(spark, sf_dir, "part").select("p_partkey", items.alias("items"), F.lit("total").alias("quantity"))
    return K.export_rows(rows, "items", "quantity").select("p_partkey", F.col("item_index").cast("int").alias("item_index"), "item_quantity")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'XL' WHEN p_size >= 20 THEN CAST(p_size AS VARCHAR) ELSE '' END AS size FROM part")
def inferred_sizes(spark, sf_dir):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("x 38 尺码："), F.lit("XL"))).otherwise(F.concat(F.lit("a"), F.col("p_size").cast("string"), F.lit("b 123")))
    return load(spark, sf_dir, "part").select("p_partkey", K.infer_size(F.lit(None), text).alias("size"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN p_brand ELSE p_name END AS spec, CASE WHEN p_size % 4 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(p_size AS BIGINT) END AS quantity FROM part")
def report_preview(spark, sf_dir):
    third = F.col("p_size") % 3
    sku, attr = F.when(third == 0, F.concat("p_name", F.lit("-"), "p_type")), F.when(third == 1, F.col("p_brand")).otherwise(" ")
    quantity = F.when(F.col("p_size") % 4 == 0, "many").otherwise(F.concat(F.lit("about "), "p_size", F.lit(" of 99")))
    return load(spark, sf_dir, "part").select("p_partkey", K.preview_spec(sku, attr, F.col("p_name")).alias("spec"), K.preview_quantity(quantity).alias("quantity"))


@query("WITH e AS (SELECT event_id, event_id % 4 AS kind, date_trunc('second', CAST(ts AS TIMESTAMP)) AS t FROM events) SELECT event_id, CASE kind WHEN 0 THEN t WHEN 1 THEN t - INTERVAL 8 HOUR WHEN 2 THEN date_trunc('minute', t) END AS utc, CASE kind WHEN 0 THEN t WHEN 1 THEN t - INTERVAL 8 HOUR WHEN 2 THEN date_trunc('minute', t) - INTERVAL 8 HOUR END AS collector, strftime(CASE kind WHEN 0 THEN t + INTERVAL 8 HOUR WHEN 1 THEN t WHEN 2 THEN date_trunc('minute', t) + INTERVAL 8 HOUR END, '%Y-%m-%d %H:%M:%S') AS local FROM e")
def iso_times(spark, sf_dir):
    kind, shown = F.col("event_id") % 4, lambda form: F.date_format("ts", form)
    text = F.when(kind == 0, shown("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 1, shown("yyyy-MM-dd'T'HH:mm:ss'+08:00'")).when(kind == 2, shown("yyyy-MM-dd HH:mm")).otherwise(shown("yyyy-02-30'T'HH:mm:ss'Z'"))
    rows = load(spark, sf_dir, "events").select("event_id", text.alias("text"))
    utc = K.utc_time(F.col("text"))
    return rows.select("event_id", utc.alias("utc"), K.utc_time(F.col("text"), "+08:00").alias("collector"), K.local_text(utc).alias("local"))


@query("SELECT p_partkey, CAST(least(greatest(p_size, 8), 60) AS INT) AS width, CASE WHEN p_size * 9 >= 61 THEN round_even((p_size * 9 - 5) / 7.0, 2) ELSE 8.0 END AS units FROM part")
def sheet_units(spark, sf_dir):
    size = F.col("p_size")
    return load(spark, sf_dir, "part").select("p_partkey", K.bounded(size, 12, 8, 60).alias("width"), K.scaled(size, 9, 5, 7.0, 8.0).alias("units"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{\"raw_text\":\"a \\\"b\\\" \\\\' || event_type || '\"}' WHEN 2 THEN '{\"raw_value\":[1,2]}' ELSE '{\"raw_value\":null}' END AS payload, CASE event_id % 4 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS depth FROM (SELECT event_id, event_type, replace(props, ' ', '') AS props FROM events)")
def json_payloads(spark, sf_dir):
    case = F.col("event_id") % 4
    raw = F.when(case == 0, F.col("props")).when(case == 1, F.concat(F.lit('a "b" \\'), "event_type")).when(case == 2, "[1, 2]").otherwise("null")
    return load(spark, sf_dir, "events").select("event_id", K.json_payload(raw).alias("payload"), K.json_depth(raw).alias("depth"))


@query("SELECT l_orderkey, 'l_partkey' AS field, CAST(l_partkey AS VARCHAR) AS value FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3) UNION ALL SELECT l_orderkey, 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def missing_references(spark, sf_dir):
    lines, part, supplier = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part").where("p_size > 3"), load(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return K.missing_references(lines, {"l_partkey": (part, "p_partkey"), "l_suppkey": (supplier, "s_suppkey")}, "l_orderkey")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS a, p_name AS b FROM part")
def merged_maps(spark, sf_dir):
    first = F.create_map(F.lit("a"), F.col("p_type"), F.lit("b"), F.col("p_name"))
    second = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("a"), F.col("p_brand"))).otherwise(F.create_map().cast("map<string,string>"))
    m = K.merged(first, second)
    return load(spark, sf_dir, "part").select("p_partkey", m["a"].alias("a"), m["b"].alias("b"))
