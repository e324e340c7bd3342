"""The registered queries of the order, matching, report, coverage, capture, reading and rule operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import coverage as C
from tallyloom.operators import evidence as V
from tallyloom.operators import fingerprint as P
from tallyloom.operators import match as M
from tallyloom.operators import parse as A
from tallyloom.operators import reading as R
from tallyloom.operators import records as S
from tallyloom.operators import report as L
from tallyloom.operators import rules as U
from tallyloom.plans.tables import PRODUCTS, RULES, WINDOWS, load, order_rows, skus, spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: SQL of order rows with the five fields, and of their hits.
ROWS_SQL = "rows_ AS (SELECT l.*, p.*, trim(p_name) AS product, trim(p_type) AS sales_attr1, CAST(p_size AS VARCHAR) AS sales_attr2, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS quantity, trim(l_returnflag) AS remark FROM lineitem l JOIN part p ON l_partkey = p_partkey)"
RULES_SQL = "rules_(rule_id, keyword, kind, priority, product_id, sku_id, image_id) AS (VALUES (1, 'ring', 'c', 10, 1, -1, -1), (2, 'bolt', 'c', 20, 2, -1, -1), (3, 'red', 'r', 5, 3, -1, -1), (4, 'newwidget', 'e', 1, 4, 41, -1), (5, 'anvil', 'c', 30, 5, -1, 7))"
KEY_SQL = "keyed_ AS (SELECT *, row_number() OVER () AS rid, replace(lower(product), ' ', '') AS np, replace(lower(remark), ' ', '') AS nr FROM rows_)"
HITS_SQL = "hits_ AS (SELECT rid, count(*) AS n, count(DISTINCT (product_id, sku_id, image_id)) AS targets, arg_min((rule_id, product_id, sku_id, image_id), priority * 1000 + rule_id) AS first FROM keyed_ JOIN rules_ ON (kind = 'c' AND contains(np, keyword)) OR (kind = 'r' AND (contains(np, keyword) OR contains(nr, keyword))) OR (kind = 'e' AND np = keyword) GROUP BY rid)"
STATUS_SQL = f"WITH {ROWS_SQL}, {RULES_SQL}, {KEY_SQL}, {HITS_SQL}, status_ AS (SELECT k.*, CASE WHEN h.n IS NULL THEN 'product_unmatched' WHEN targets > 1 THEN 'conflict' ELSE 'hit' END AS match_status, first[1] AS rule_id, first[2] AS product_id, first[3] AS sku_id, first[4] AS image_id FROM keyed_ k LEFT JOIN hits_ h USING (rid))"


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_status(M.rule_hits(order_rows(spark, sf_dir), RULES))


# ---- scans and projections ----


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) ORDER BY o_orderkey DESC LIMIT 50 OFFSET 10")
def active_scan_page(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    live = S.active(orders, deleted=F.col("o_orderstatus") == "F", workspaces=[1, 2, 3, 5, 8, 13, 21, 34, 55, 89], workspace=F.col("o_custkey"))
    return S.page(live, [F.desc("o_orderkey")], 10, 50).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%Ring%'")
def keyword_search(spark, sf_dir):
    return S.keyword_search(load(spark, sf_dir, "part"), "p_name", "Ring").select("p_partkey", "p_name")


@query(f"WITH {ROWS_SQL} SELECT l_orderkey, l_linenumber, product, sales_attr1, sales_attr2, quantity, remark FROM rows_")
def five_field_rows(spark, sf_dir):
    return order_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", *M.FIELDS)


@query("SELECT CAST(count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1998-01-01') AS BIGINT) AS active, CAST(count(*) FILTER (WHERE o_orderdate <= TIMESTAMP '1998-01-01') AS BIGINT) AS archived, CAST(count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderstatus = 'O') AS BIGINT) AS collecting FROM orders")
def capture_summary(spark, sf_dir):
    old = F.col("o_orderdate") <= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return S.capture_summary(load(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O", old)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-30'")
def retention_cutoff(spark, sf_dir):
    return S.before_cutoff(load(spark, sf_dir, "orders"), F.lit("1995-06-30 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate")).select("o_orderkey")


# ---- matching ----


@query(f"{STATUS_SQL} SELECT l_orderkey, l_linenumber, product, match_status, CAST(rule_id AS BIGINT) AS rule_id FROM status_")
def rule_match_status(spark, sf_dir):
    return statuses(spark, sf_dir).select("l_orderkey", "l_linenumber", "product", "match_status", F.col("rule.rule_id").alias("rule_id"))


@query(f"{STATUS_SQL} SELECT product, CAST(rule_id AS BIGINT) AS rule_id, count(*) AS n FROM status_ WHERE match_status = 'conflict' GROUP BY ALL")
def rule_conflicts(spark, sf_dir):
    return statuses(spark, sf_dir).where("match_status = 'conflict'").groupBy("product", F.col("rule.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


@query("WITH r(rule_id, keyword) AS (VALUES (1, 'ring'), (2, 'bolt'), (3, 'red'), (4, 'newwidget'), (5, 'anvil')) SELECT p_partkey, string_agg(CAST(rule_id AS VARCHAR), ',' ORDER BY rule_id) AS rules FROM part, r WHERE (rule_id = 4 AND replace(lower(p_name), ' ', '') = keyword) OR (rule_id <> 4 AND contains(replace(lower(p_name), ' ', ''), keyword)) GROUP BY p_partkey")
def rule_hits_by_join(spark, sf_dir):
    rows = M.five_fields(load(spark, sf_dir, "part"), {"product": "p_name"})
    rules = spark.createDataFrame([(i, "product", k, "exact" if i == 4 else "contains", i, i, None, None) for i, k in enumerate(["ring", "bolt", "red", "new widget", "anvil"], 1)], "id long, field string, keyword string, kind string, priority int, product_id long, sku_id long, image_id long")
    hits = M.rule_hits_joined(rows, rules, "p_partkey")
    return hits.select("p_partkey", F.array_join(F.array_sort(F.transform("hits", lambda h: h["rule_id"].cast("string"))), ",").alias("rules"))


SKU_SQL = "WITH s AS (SELECT DISTINCT pid AS product_id, p_brand AS sku_id, term FROM part, (VALUES (1), (2), (3), (4), (5)) t(pid), LATERAL (SELECT unnest([p_brand, p_type]) AS term)), v AS (SELECT p_partkey, 1 + p_partkey % 5 AS product_id, unnest([p_type, p_brand]) AS value FROM part), n AS (SELECT p_partkey, v.product_id, sku_id, replace(lower(value), ' ', '') AS a, replace(lower(term), ' ', '') AS t FROM v JOIN s USING (product_id)), scored AS (SELECT p_partkey, product_id, sku_id, max(CASE WHEN a = t THEN 10000 + length(t) WHEN contains(a, t) THEN 5000 + length(t) WHEN contains(t, a) THEN 1000 + length(a) ELSE 0 END) AS score FROM n GROUP BY ALL), best AS (SELECT p_partkey, max(score) AS score FROM scored WHERE score > 0 GROUP BY p_partkey)"


def _best_sku(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 5 + 1).alias("product_id"), "p_type", "p_brand")
    return M.best_sku(rows, skus(spark, sf_dir), ["p_partkey"], ["p_type", "p_brand"])


@query(SKU_SQL + " SELECT p_partkey, CAST(score AS BIGINT) AS score, count(*) AS n_best, CASE WHEN count(*) = 1 THEN max(sku_id) END AS sku_id FROM scored JOIN best USING (p_partkey, score) GROUP BY p_partkey, score")
def sku_top_score(spark, sf_dir):
    return _best_sku(spark, sf_dir).withColumn("score", F.col("score").cast("bigint"))


@query(SKU_SQL + " SELECT product_id, count(*) AS n_rows, CAST(count(*) FILTER (WHERE k > 1) AS BIGINT) AS n_ambiguous FROM (SELECT p_partkey, 1 + p_partkey % 5 AS product_id, count(*) AS k FROM scored JOIN best USING (p_partkey, score) GROUP BY p_partkey) GROUP BY product_id")
def sku_ambiguous(spark, sf_dir):
    top = _best_sku(spark, sf_dir).withColumn("product_id", F.col("p_partkey") % 5 + 1)
    return top.groupBy("product_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("n_best") > 1).alias("n_ambiguous"))


#: SKUs with numbers: a hundred times the product, and the brand's.
NUMBER = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT)"
LINK_SQL = f"""WITH {RULES_SQL}, r_ AS (SELECT p_partkey, p_type, p_brand, p_size, replace(lower(p_name), ' ', '') AS np, CASE WHEN p_size % 11 = 0 THEN 'special' WHEN p_size % 13 = 0 THEN 'needs_review' ELSE 'draft' END AS parse, replace(lower(CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_type ELSE 'x' || p_brand || 'y' END), ' ', '') AS value FROM part),
h_ AS (SELECT p_partkey, count(DISTINCT (product_id, sku_id, image_id)) AS targets, arg_min((product_id, sku_id, image_id), priority * 1000 + rule_id) AS f FROM r_ JOIN rules_ ON (kind <> 'e' AND contains(np, keyword)) OR (kind = 'e' AND np = keyword) GROUP BY p_partkey),
t_ AS (SELECT DISTINCT pid AS product_id, pid * 100 + {NUMBER} AS sku_id, replace(lower(term), ' ', '') AS term FROM part, (VALUES (1), (2), (3), (5)) x(pid), LATERAL (SELECT unnest([p_brand, p_type]) AS term) WHERE {NUMBER} % 2 = 0 OR pid <> 2),
c_ AS (SELECT p_partkey, sku_id, max(CASE WHEN value = term THEN 10000 + length(term) WHEN contains(value, term) THEN 5000 + length(term) WHEN contains(term, value) THEN 1000 + length(value) ELSE 0 END) AS score FROM r_ JOIN h_ USING (p_partkey) JOIN t_ ON product_id = f[1] WHERE targets = 1 AND parse = 'draft' AND f[2] = -1 GROUP BY ALL),
b_ AS (SELECT p_partkey, count(*) AS n_best, max(sku_id) AS sku_id FROM (SELECT *, max(score) OVER (PARTITION BY p_partkey) AS top FROM c_ WHERE score > 0) WHERE score = top GROUP BY p_partkey),
l_ AS (SELECT p_partkey, CASE WHEN parse = 'special' THEN 'special' WHEN parse <> 'draft' THEN 'pending' WHEN targets IS NULL THEN 'product_unmatched' WHEN targets > 1 THEN 'conflict' WHEN n_best > 1 THEN 'sku_ambiguous' WHEN n_best IS NULL THEN 'sku_unmatched' ELSE 'matched' END AS match_status, sku_id, f FROM r_ LEFT JOIN h_ USING (p_partkey) LEFT JOIN b_ USING (p_partkey))"""


def linked(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    size = F.col("p_size") % 3
    parts = part.select("p_partkey", "p_name", F.when(size == 0, F.col("p_brand")).when(size == 1, F.col("p_type")).otherwise(F.concat(F.lit("x"), "p_brand", F.lit("y"))).alias("attr"), F.when(F.col("p_size") % 11 == 0, "special").when(F.col("p_size") % 13 == 0, "needs_review").otherwise("draft").alias("parse_status"))
    rows = M.match_status(M.rule_hits(M.five_fields(parts, {"product": "p_name", "sales_attr2": "attr"}), RULES))
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("bigint")
    terms = part.select(F.explode(F.array(*[F.lit(p).cast("bigint") for p in (1, 2, 3, 5)])).alias("product_id"), number.alias("brand"), "p_brand", "p_type").where("brand % 2 = 0 or product_id != 2")
    dim = terms.groupBy("product_id", "brand", "p_brand").agg(F.concat(F.array("p_brand"), F.collect_set("p_type")).alias("terms"))
    dim = dim.select("product_id", (F.col("product_id") * 100 + F.col("brand")).alias("sku_id"), F.col("p_brand").alias("sku_name"), "terms", (F.col("brand") % 5 + 1).alias("image_id"), F.when(F.col("brand") % 4 != 0, F.col("brand")).alias("stall_id"), F.lit(" ").alias("stall_name"))
    products = spark.createDataFrame([(p, n, p + 50, f"stall {p}") for p, n in PRODUCTS.items()], "product_id long, product_name string, stall_id long, stall_name string")
    images = spark.createDataFrame([(1, "one"), (2, "two"), (7, "seven")], "image_id long, image_name string")
    return M.linked(rows, products, dim, images, ["sales_attr2"], "p_partkey")


@query(f"""{LINK_SQL} SELECT p_partkey, match_status, CASE WHEN match_status = 'matched' THEN sku_id END AS sku_id, CASE WHEN match_status = 'matched' THEN CASE WHEN f[3] > 0 THEN f[3] ELSE sku_id % 100 % 5 + 1 END END AS image_id, CASE WHEN match_status = 'matched' THEN CASE CASE WHEN f[3] > 0 THEN f[3] ELSE sku_id % 100 % 5 + 1 END WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 7 THEN 'seven' END END AS image_name, CASE WHEN match_status = 'matched' THEN CASE WHEN sku_id % 100 % 4 <> 0 THEN sku_id % 100 ELSE f[1] + 50 END END AS stall_id, CASE WHEN match_status = 'matched' THEN 'stall ' || f[1] END AS stall_name FROM l_""")
def linked_rows(spark, sf_dir):
    only = lambda c: F.when(F.col("match_status") == "matched", F.col(c)).alias(c)
    return linked(spark, sf_dir).withColumn("sku_id", F.col("use_sku")).select("p_partkey", "match_status", only("sku_id"), only("image_id"), only("image_name"), only("stall_id"), only("stall_name"))


@query(f"{LINK_SQL}, dim(match_status) AS (VALUES ('conflict'), ('image_unmatched'), ('matched'), ('pending'), ('product_unmatched'), ('sku_ambiguous'), ('sku_unmatched'), ('special')) SELECT match_status, CAST(coalesce(n, 0) AS BIGINT) AS n FROM dim LEFT JOIN (SELECT match_status, count(*) AS n FROM l_ GROUP BY 1) USING (match_status) UNION ALL SELECT 'total', count(*) FROM l_")
def linking_summary(spark, sf_dir):
    return M.status_summary(linked(spark, sf_dir))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_nationkey ELSE n_regionkey END AS stall_id, CASE WHEN s_acctbal > 5000 THEN s_name ELSE n_name END AS stall_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def asset_lookup_chain(spark, sf_dir):
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    own_id, own_name = F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")), F.when(F.col("s_acctbal") > 5000, F.col("s_name"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", F.coalesce(own_id, "n_regionkey").alias("stall_id"), F.coalesce(own_name, "n_name").alias("stall_name"))


@query(f"{STATUS_SQL}, dim(match_status) AS (VALUES ('conflict'), ('hit'), ('matched'), ('pending'), ('product_unmatched'), ('special')) SELECT match_status, CAST(coalesce(n, 0) AS BIGINT) AS n FROM dim LEFT JOIN (SELECT match_status, count(*) AS n FROM status_ GROUP BY 1) USING (match_status) UNION ALL SELECT 'total', count(*) FROM status_")
def status_summary(spark, sf_dir):
    return M.status_summary(statuses(spark, sf_dir), ("conflict", "hit", "matched", "pending", "product_unmatched", "special"))


@query(f"{STATUS_SQL}, r(rule_id, p, s, i) AS (VALUES (1, 1, -1, -1), (2, 2, -1, -1), (3, 3, -1, -1), (4, 4, 41, -1), (5, 5, -1, 7), (6, 6, -1, -1)) SELECT CAST(r.rule_id AS BIGINT) AS rule_id, CAST(count(*) FILTER (WHERE match_status = 'hit' AND (product_id, sku_id, image_id) = (p, s, i)) AS BIGINT) AS matched_count, CAST(count(*) FILTER (WHERE match_status = 'conflict' AND (product_id, sku_id, image_id) = (p, s, i)) AS BIGINT) AS conflict_count, CAST(count(*) FILTER (WHERE match_status = 'product_unmatched') AS BIGINT) AS unmatched_count FROM r, status_ GROUP BY r.rule_id")
def rule_preview_counts(spark, sf_dir):
    return M.rule_preview(statuses(spark, sf_dir), RULES)


@query(f"{STATUS_SQL} SELECT match_status, CAST(rn AS INT) AS rn, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY match_status ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM status_) WHERE rn <= 5")
def status_samples(spark, sf_dir):
    return M.status_samples(statuses(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("match_status", "rn", "l_orderkey", "l_linenumber", "l_partkey")


# ---- reports ----

NAMES_SQL = "names_(product_id, product_name) AS (VALUES (1, 'Ring'), (2, 'Bolt'), (3, 'Red goods'), (4, 'Widget'), (5, 'Anvil'))"
LINES_SQL = f"{STATUS_SQL}, {NAMES_SQL}, lines_ AS (SELECT n_name AS stall_name, n_nationkey AS stall_id, product_name, s.product_id, sales_attr1 AS spec, sales_attr2 AS size_text, CAST(l_quantity AS BIGINT) AS n, remark, image_id, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM status_ s JOIN names_ USING (product_id) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE match_status = 'hit')"


def report_lines(spark, sf_dir):
    rows = statuses(spark, sf_dir)
    names = F.create_map(*[F.lit(x) for p in PRODUCTS.items() for x in p])
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    stalls = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", F.col("n_nationkey").alias("stall_id"), F.col("n_name").alias("stall_name"))
    rows = rows.join(stalls, rows["l_suppkey"] == stalls["s_suppkey"])
    rows = rows.withColumns({"status": F.when(F.col("match_status") == "hit", "matched").otherwise(F.col("match_status")), "product_id": F.col("rule.product_id"), "sku_id": F.lit(None).cast("bigint"), "image_id": F.col("rule.image_id"), "item_count": F.lit(1), "image_match_text": F.col("product")})
    return L.line_items(rows.withColumn("product_name", names[F.col("product_id").cast("int")]))


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(f"{LINES_SQL} SELECT stall_name, product_name, spec, string_agg(size_text, ' ' ORDER BY CAST(size_text AS INT)) AS size_text, CAST(sum(n) AS BIGINT) AS quantity, remark FROM (SELECT stall_name, product_name, spec, size_text, n, (SELECT string_agg(r, chr(10) ORDER BY a) FROM (SELECT remark AS r, min(ord) AS a FROM lines_ j WHERE (j.stall_name, j.product_name, j.spec, j.image_id) = (g.stall_name, g.product_name, g.spec, g.image_id) GROUP BY remark)) AS remark FROM (SELECT stall_name, product_name, spec, image_id, size_text, sum(n) AS n FROM lines_ GROUP BY ALL) g) GROUP BY stall_name, product_name, spec, remark")
def report_by_stall(spark, sf_dir):
    lines = L.stacked(report_lines(spark, sf_dir), ORDER, stack_sizes=True, with_texts=False)
    return L.natural_order(lines).select("stall_name", "product_name", "spec", "size_text", "quantity", "remark")


@query(f"{LINES_SQL} SELECT stall_name, product_name, spec, string_agg(repeat(size_text || ' ', n), '' ORDER BY CAST(size_text AS INT)) AS sizes FROM (SELECT stall_name, product_name, spec, image_id, size_text, CAST(sum(n) AS INT) AS n FROM lines_ GROUP BY ALL) GROUP BY stall_name, product_name, spec, image_id")
def report_sizes_repeated(spark, sf_dir):
    lines = L.stacked(report_lines(spark, sf_dir), ORDER, with_texts=False)
    return lines.select("stall_name", "product_name", "spec", F.concat("size_text", F.lit(" ")).alias("sizes"))


@query(f"{LINES_SQL} SELECT stall_name, product_name, spec, size_text, n AS quantity, remark FROM lines_")
def report_unstacked(spark, sf_dir):
    return report_lines(spark, sf_dir).select("stall_name", "product_name", "spec", "size_text", F.col("n").alias("quantity"), "remark")


@query(f"{LINES_SQL} SELECT stall_name, count(*) AS n_lines, CAST(sum(q) AS BIGINT) AS quantity FROM (SELECT stall_name, product_name, spec, image_id, sum(n) AS q FROM lines_ GROUP BY ALL) GROUP BY stall_name")
def stall_partition_counts(spark, sf_dir):
    return L.by_stall(L.stacked(report_lines(spark, sf_dir), ORDER, stack_sizes=True, with_texts=False))


@query(f"{LINES_SQL} SELECT stall_name, string_agg(spec, '|' ORDER BY a) AS specs FROM (SELECT stall_name, spec, min(ord) AS a FROM lines_ GROUP BY ALL) GROUP BY stall_name")
def ordered_distinct_concat(spark, sf_dir):
    first = report_lines(spark, sf_dir).groupBy("stall_name", "spec").agg(F.min(F.struct(*ORDER)).alias("a"))
    return first.groupBy("stall_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "spec"))), lambda s: s["spec"]), "|").alias("specs"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '^[ \\t\\r\\n]*[=+\\-@]') THEN '''' || text ELSE text END AS cell FROM documents UNION ALL SELECT c_custkey, CASE WHEN r < 0 THEN '''' ELSE '' END || CAST(r AS VARCHAR) FROM (SELECT c_custkey, CAST(sign(c_acctbal) * floor(abs(c_acctbal) + 0.5) AS INT) AS r FROM customer)")
def safe_cell(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", X.safe_cell(F.col("text")).alias("cell"))
    return docs.unionByName(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), X.safe_cell(F.round("c_acctbal").cast("int").cast("string")).alias("cell")))


# ---- coverage ----

COVER_SQL = "rows_ AS (SELECT l_orderkey AS raw, l_returnflag <> 'R' AS ok, l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber > 6 AS mute, (l_partkey, l_quantity, l_returnflag) AS body FROM lineitem), p_ AS (SELECT raw, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE mute) AS n_mute, count(*) - count(DISTINCT body) AS dup FROM rows_ GROUP BY raw), j_ AS (SELECT o_orderkey, p_.* FROM orders FULL JOIN p_ ON o_orderkey = raw), o_ AS (SELECT *, CASE WHEN n IS NULL THEN NULL WHEN n_ok = n THEN 'normal' WHEN n_mute = 0 THEN 'exception' ELSE 'mute' END AS outcome FROM j_)"


def coverage_report_frame(spark, sf_dir):
    expected = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("raw_record_id"), F.lit(1).cast("bigint").alias("parent_sequence"))
    line = load(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    rows = line.select(
        F.col("l_orderkey").alias("raw_record_id"),
        F.lit(1).cast("bigint").alias("parent_sequence"),
        F.when(returned, "pending").otherwise("matched").alias("status"),
        F.lit(1).alias("product_id"),
        F.lit("x").alias("product_name"),
        F.col("l_partkey").cast("string").alias("product_text"),
        F.lit("").alias("sales_attr1_text"),
        F.lit("").alias("sales_attr2_text"),
        F.col("l_quantity").cast("string").alias("quantity_text"),
        F.col("l_returnflag").alias("remark_text"),
        F.when(returned & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") > 6), "").otherwise("returned").alias("exception"),
    )
    return C.coverage(expected, rows)


@query(f"WITH {COVER_SQL} SELECT CAST(count(o_orderkey) AS BIGINT) AS expected_parent_count, count(n) AS recognized_parent_count, CAST(count(*) FILTER (WHERE outcome = 'normal') AS BIGINT) AS normal_parent_count, CAST(count(*) FILTER (WHERE outcome = 'exception') AS BIGINT) AS exception_parent_count, CAST(sum(n) AS BIGINT) AS result_row_count FROM o_")
def coverage_report(spark, sf_dir):
    return coverage_report_frame(spark, sf_dir).select("expected_parent_count", "recognized_parent_count", "normal_parent_count", "exception_parent_count", "result_row_count")


@query(f"WITH {COVER_SQL} SELECT code, CAST(n AS BIGINT) AS n FROM (SELECT 'parent_count_mismatch' AS code, abs(count(o_orderkey) - count(n)) AS n FROM o_ UNION ALL SELECT 'raw_record_uncovered', count(*) FROM o_ WHERE n IS NULL UNION ALL SELECT 'exception_not_actionable', count(*) FROM o_ WHERE outcome = 'mute' UNION ALL SELECT 'parent_partition_incomplete', count(*) FROM o_ WHERE (o_orderkey IS NOT NULL) <> coalesce(outcome IN ('normal', 'exception'), false) UNION ALL SELECT 'duplicate_child_rows', sum(dup) FROM o_ UNION ALL SELECT 'high_child_count', count(*) FROM o_ WHERE n > 10 UNION ALL SELECT 'mixed_parent_outcomes', count(*) FROM o_ WHERE n_ok > 0 AND n_ok < n) WHERE n > 0")
def coverage_failures(spark, sf_dir):
    return C.failures(coverage_report_frame(spark, sf_dir))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT (o_custkey % 7 = 0 AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1))")
def unmapped_anti_join(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    numbers = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    records = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).where("o_custkey % 7 = 0")
    records = records.unionByName(orders.select("o_custkey").where("o_custkey % 7 = 0")).distinct()
    return S.unmapped(orders, numbers, records, "o_orderkey", "o_custkey")


@query("SELECT o_orderkey AS order_key, 'mapped' AS kind FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT o_orderkey, 'pending' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending_union(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"))
    keys = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"))
    found = orders.join(keys.distinct().withColumn("kind", F.lit("mapped")).hint("merge"), "order_key", "left")  # an order's lines are one key before they are sorted
    return found.select("order_key", F.coalesce("kind", F.lit("pending")).alias("kind"))


@query("SELECT o_custkey AS key, 'orders' AS source, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1 UNION ALL SELECT c_custkey, 'customer', 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def source_precedence(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("key"))
    cust = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return S.by_precedence([(orders, "orders"), (cust, "customer")], "key").groupBy("key", "source").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n_orders, CAST(sum(n) AS BIGINT) AS n_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY o_custkey")
def task_counts(spark, sf_dir):
    counts = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return load(spark, sf_dir, "orders").join(counts, "o_orderkey", "left").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("n").alias("n_lines"))


@query("SELECT l_partkey, l_suppkey, l_quantity, CAST(count(*) FILTER (WHERE s = 1) AS BIGINT) AS n_left, CAST(count(*) FILTER (WHERE s = 2) AS BIGINT) AS n_right FROM (SELECT l_partkey, l_suppkey, l_quantity, 1 AS s FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT l_partkey, l_suppkey, l_quantity, 2 FROM lineitem WHERE l_linenumber <= 4) GROUP BY ALL HAVING n_left <> n_right")
def multiset_compare(spark, sf_dir):
    cols = ["l_partkey", "l_suppkey", "l_quantity"]
    line = load(spark, sf_dir, "lineitem")
    return S.multiset_difference(line.where("l_linenumber <= 3").select(*cols), line.where("l_linenumber <= 4").select(*cols))


@query("WITH old AS (SELECT source AS key, min(text) AS c FROM documents WHERE doc_id % 2 = 1 GROUP BY 1), new AS (SELECT source AS key, arg_min(text, doc_id) AS c FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT key, coalesce(sha256(new.c), sha256(old.c)) AS content_hash, CASE WHEN new.c IS NULL THEN 'kept' WHEN old.c IS NULL THEN 'imported' WHEN old.c = new.c THEN 'duplicated' ELSE 'updated' END AS outcome FROM old FULL JOIN new USING (key)")
def content_hash_dedupe_assets(spark, sf_dir):
    """Every document stands on one side: odd ids are the current assets, even ones come in."""
    docs = load(spark, sf_dir, "documents").withColumnsRenamed({"source": "key", "text": "content"})
    old = docs.where("doc_id % 2 = 1").groupBy("key").agg(F.min("content").alias("content"))
    return S.merge_assets(old, docs.where("doc_id % 2 = 0"), "key", "content", ["doc_id"])


# ---- numbering, capture, events ----


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS parent_sequence FROM conversations")
def parent_sequence(spark, sf_dir):
    return S.number_parents(load(spark, sf_dir, "conversations"), "role", ["conv_id", "turn"]).select("conv_id", "turn", "parent_sequence")


@query("WITH c AS (SELECT conv_id, count(*) AS n, conv_id % 4 AS task, CASE WHEN conv_id % 10 = 0 THEN conv_id * 100 END AS explicit FROM conversations GROUP BY conv_id), r AS (SELECT *, sum(CASE WHEN explicit IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY task ORDER BY conv_id) AS g FROM c) SELECT conv_id, CAST(coalesce(first_value(explicit) OVER w, 1) + coalesce(sum(n) OVER (PARTITION BY task, g ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_sequence FROM r WINDOW w AS (PARTITION BY task, g ORDER BY conv_id)")
def running_sequences(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"task": F.col("conv_id") % 4, "explicit": F.when(F.col("conv_id") % 10 == 0, F.col("conv_id") * 100)})
    return S.running_sequences(c, "task", ["conv_id"], "n", "explicit").select("conv_id", "first_sequence")


WINDOWS_SQL = "w(window_id, started_at, ended_at) AS (VALUES (1, TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-08 00:00:00'), (2, TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-12 12:00:00'), (3, TIMESTAMP '2024-01-20 00:00:00', NULL))"


def windows(spark):
    raw = spark.createDataFrame(WINDOWS, "window_id long, a string, b string")
    return raw.select("window_id", F.col("a").cast("timestamp_ntz").alias("started_at"), F.col("b").cast("timestamp_ntz").alias("ended_at"))


@query(f"WITH {WINDOWS_SQL} SELECT event_id, CAST(max(window_id) AS BIGINT) AS window_id FROM events LEFT JOIN w ON ts >= started_at AND (ended_at IS NULL OR ts <= ended_at) GROUP BY event_id")
def window_assignment(spark, sf_dir):
    return S.assign_windows(load(spark, sf_dir, "events"), windows(spark), "ts", ["event_id"])


@query("SELECT sha256('w' || chr(0) || CAST(user_id % 5 AS VARCHAR) || chr(0) || event_type || chr(0) || CAST(event_id AS VARCHAR)) AS event_key, min(event_id) AS event_id, min(ts) AS ts FROM events GROUP BY 1")
def event_key_dedupe(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    replay = e.unionByName(e.where("event_id % 3 = 0"))
    keyed = replay.select(S.event_key(F.lit("w"), F.col("user_id") % 5, F.col("event_type"), F.col("event_id")).alias("event_key"), "event_id", "ts")
    return S.first_of_each(keyed, "event_key", ["event_id"])


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN event_id % 97 = 0 THEN 'invalid_time' WHEN ts < TIMESTAMP '2024-01-03' OR ts > TIMESTAMP '2024-01-15 06:00:00' THEN 'rejected' WHEN user_id % 2 = 0 THEN 'late' ELSE 'inserted' END AS kind FROM events) GROUP BY 1")
def late_and_rejected(spark, sf_dir):
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    kind = S.classify(F.col("ts"), F.col("event_id") % 97 != 0, ntz("2024-01-03 00:00:00.700"), ntz("2024-01-15 06:00:00"), F.col("user_id") % 2 == 0)
    return load(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("WITH c(event_type, cursor) AS (SELECT DISTINCT event_type, 500 FROM events) SELECT c.event_type, CAST(greatest(m - cursor, 0) AS BIGINT) AS pending, a AS first_time, b AS last_time FROM c JOIN (SELECT event_type, max(event_id) AS m, min(ts) FILTER (WHERE event_id > 500) AS a, max(ts) FILTER (WHERE event_id > 500) AS b FROM events GROUP BY 1) USING (event_type)")
def pending_profile(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return S.pending_profile(e, "event_type", "event_id", "ts", e.select("event_type").distinct().withColumn("cursor", F.lit(500)))


@query("SELECT user_id, count(*) AS n, list_reduce(list_prepend('', list(CAST(rn AS VARCHAR) || chr(0) || sha256(props) ORDER BY rn)), lambda h, r: sha256(h || r)) AS chain FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY user_id")
def hash_chain(spark, sf_dir):
    return S.hash_chain(load(spark, sf_dir, "events"), "user_id", ["event_id"], F.col("props"))


# ---- reading ----


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props_path(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, 0 AS leaf_order, 'k' AS path, json_extract_string(props, '$.k') AS text FROM events")
def json_leaf_walk(spark, sf_dir):
    return R.walk_leaves(load(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "leaf_order", "path", "text")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'technical_field_name' WHEN doc_id % 4 = 1 THEN 'technical_field_path' WHEN doc_id % 4 = 2 THEN CASE WHEN regexp_matches(source, '^[A-Za-z0-9_-]{16,}$') THEN 'technical_value' END ELSE 'not_business_relevant' END AS reason FROM documents")
def raw_field_filter(spark, sf_dir):
    path = F.element_at(F.array(F.lit("task.rowid"), F.lit("task.login_token.value"), F.lit("data.items[0].remark"), F.lit("data.other")), (F.col("doc_id") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "documents").select("doc_id", R.field_filter_reason(path, F.col("source")).alias("reason"))


@query(r"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS line_number, CAST(start AS BIGINT) AS start, CAST(start + length(line) AS BIGINT) AS end, sha256(line) AS line_sha256 FROM (SELECT doc_id, pos, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) WHERE regexp_matches(line, '\S')")
def document_lines(spark, sf_dir):
    return R.document_lines(load(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "line_number", "start", "end", F.sha2("line", 256).alias("line_sha256"))


#: SQL of segments() over a text t: its trimmed parts between delimiters, then before a quantity mark or a size at the end; RE2 has no look-around.
SPACE_SQL = r"[\s\x{0B}\x{85}\p{Z}]"
TRIM_SQL = rf"^{SPACE_SQL}+|{SPACE_SQL}+$"


def clean_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '[\x00-\x08\x0B-\x1F]|\p{{Cf}}', '', 'g'), '{TRIM_SQL}', '', 'g')"


LABELLED_SQL = "^\\s*(?:颜色分类|颜色|色号|鞋码|尺码|码数|号码|规格|款式)\\s*[:：]"
SEGMENTS_SQL = rf"""
cut_ AS (SELECT id, i, j, {clean_sql("p")} AS p FROM (SELECT id, i, unnest(x) AS p, generate_subscripts(x, 1) AS j FROM (SELECT id, i, regexp_split_to_array(l, CASE WHEN regexp_matches(l, '{LABELLED_SQL}') THEN '[,，、|]+' ELSE '[,，、|/]+' END) AS x FROM (SELECT id, i, {clean_sql("l")} AS l FROM (SELECT id, unnest(y) AS l, generate_subscripts(y, 1) AS i FROM (SELECT id, regexp_split_to_array(regexp_replace({clean_sql("t")}, '[；;]\s*', chr(10), 'g'), '\n+') AS y FROM texts_)))))),
marked_ AS (SELECT id, i, j, p, regexp_matches(p, '^.+?\s*[*xX×]\s*\d+(?:\.\d+)?$') AS q, regexp_split_to_array(p, '\s+') AS w FROM cut_ WHERE p <> ''),
tail_ AS (SELECT *, array_to_string(w[:-2], ' ') AS head, len(w) >= 2 AND regexp_matches(w[-1], '(?i)^(?:[1-9]\d(?:\.\d)?|[SMLX]{{1,4}}|均码|加大码|大码|小码)$') AS ok FROM marked_),
pieces_ AS (SELECT id, i, j, CASE WHEN q THEN [{clean_sql("regexp_extract(p, '^(.+?)\\s*([*xX×]\\s*\\d+(?:\\.\\d+)?)$', 1)")}, regexp_replace(regexp_extract(p, '^(.+?)\s*([*xX×]\s*\d+(?:\.\d+)?)$', 2), '\s+', '', 'g')] WHEN ok AND length(head) >= 2 THEN [head, w[-1]] ELSE [p] END AS z FROM tail_),
segments_ AS (SELECT id, list(s ORDER BY i, j, k) AS found FROM (SELECT id, i, j, unnest(z) AS s, generate_subscripts(z, 1) AS k FROM pieces_) WHERE s <> '' GROUP BY id)"""


def part_segments(part):
    size = F.col("p_size").cast("string")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" ，"), "p_brand", F.lit(" "), size)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("颜色: "), "p_name", F.lit("/"), "p_brand", F.lit(" "), "p_type")).otherwise(F.concat("p_name", F.lit(" * "), size))
    return part.select("p_partkey", F.regexp_replace(F.array_join(R.segments(line), "#"), "^颜色: ", "").alias("parts"))


@query(r"SELECT p_partkey, string_agg(s, '#' ORDER BY i) AS parts FROM (SELECT p_partkey, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size >= 10 THEN [p_name, p_brand, CAST(p_size AS VARCHAR)] WHEN p_partkey % 3 = 0 THEN [p_name, p_brand || ' ' || p_size] WHEN p_partkey % 3 = 1 THEN [p_name || '/' || p_brand || ' ' || p_type] ELSE [p_name, '*' || CAST(p_size AS VARCHAR)] END AS x FROM part)) GROUP BY p_partkey")
def segment_split(spark, sf_dir):
    return part_segments(load(spark, sf_dir, "part"))


@query(f"WITH texts_ AS (SELECT doc_id AS id, text AS t FROM documents), {SEGMENTS_SQL} SELECT doc_id, CAST(coalesce(len(found), 0) AS BIGINT) AS n_segments, sha256(coalesce(array_to_string(found, '#'), '')) AS segments_sha256 FROM documents LEFT JOIN segments_ ON id = doc_id")
def segment_split_documents(spark, sf_dir):
    found = load(spark, sf_dir, "documents").select("doc_id", R.segments(F.col("text")).alias("found"))
    return found.select("doc_id", F.size("found").cast("bigint").alias("n_segments"), F.sha2(F.array_join("found", "#"), 256).alias("segments_sha256"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS quantity, p_name AS head, CAST(p_size AS VARCHAR) AS digits FROM part")
def quantity_extract(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    t = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" x"), size)).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" "), size, F.lit("双"))).otherwise(F.concat("p_name", F.lit("【"), size, F.lit("】")))
    t = F.when(F.col("p_partkey") % 3 == 2, F.concat("p_name", F.lit(" *"), size)).otherwise(t)
    cut = X.strip_trailing_quantity(t)
    return part.select("p_partkey", X.quantity_from_text(t).alias("quantity"), cut["head"].alias("head"), cut["quantity"].alias("digits"))


@query(r"SELECT doc_id, 'grammar-v1:sha256:' || sha256(CAST(to_json([CASE WHEN regexp_matches(g, '\S') THEN g ELSE '' END]) AS VARCHAR)) AS signature FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[^\p{P}\s]', '', 'g'), '[ \t]+', ' ', 'g') AS g FROM documents)")
def grammar_signature(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", P.grammar_signature(F.array("text"), exact=False).alias("signature"))


@query("SELECT event_id, 'sha256:' || sha256('{\"payload\":{\"k\":{\"type\":\"scalar\"}},\"source_component\":\"' || lower(event_type) || '\"}') AS fingerprint FROM events")
def structure_signature(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", "props", F.upper("event_type").alias("component"))
    return P.fingerprints(rows, "props", "component").select("event_id", "fingerprint")


@query("SELECT page_id, CASE WHEN contains(html, '<table') THEN 'CN-ITEM-INFO' WHEN contains(html, '<aside') THEN 'CN-PRINT-XML' WHEN contains(html, '<ul') THEN 'CN-CUSTOM-CONTENT' WHEN contains(html, '<h1') THEN 'CN-PACKAGE-ITEMS' WHEN contains(html, '<p') THEN 'CLOUD-PRODUCT-INFO' ELSE 'UNKNOWN' END AS format FROM pages")
def format_detect(spark, sf_dir):
    has = [F.col("html").contains(t) for t in ("<table", "<aside", "<ul", "<h1", "<p")]
    return load(spark, sf_dir, "pages").select("page_id", P.detect_format(*has).alias("format"))


@query(r"SELECT page_id, CAST(len(x) AS BIGINT) AS n_texts, coalesce(sha256(array_to_string(x, '|')), sha256('')) AS texts_sha256 FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(replace(replace(html, '<title>', '<text>'), '</title>', '</text>'), '(?is)<text\b[^>]*>(.*?)</text>', 1), lambda t: trim(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'))), lambda t: t <> '') AS x FROM pages)")
def xml_text_blocks(spark, sf_dir):
    html = F.replace(F.replace(F.col("html"), F.lit("<title>"), F.lit("<text>")), F.lit("</title>"), F.lit("</text>"))
    return load(spark, sf_dir, "pages").select("page_id", R.xml_texts(html).alias("x")).select("page_id", F.size("x").cast("bigint").alias("n_texts"), F.sha2(F.array_join("x", "|"), 256).alias("texts_sha256"))


def part_spans(part):
    t = part.select("p_partkey", F.concat("p_brand", F.lit("/"), (F.col("p_size") % 80 + 10).cast("string"), F.lit("双")).alias("t"))
    return V.spans(t, F.lit("part[0].text"), "t").select("p_partkey", "token_class", "start", "end", "original_text")


@query("WITH t AS (SELECT p_partkey, p_brand AS b, length(p_brand) AS n, CAST(10 + p_size % 80 AS VARCHAR) AS z, 10 + p_size % 80 BETWEEN 25 AND 59 AS sized, regexp_matches(p_brand, '(^|[^0-9])(2[5-9]|[3-5][0-9])$') AS branded FROM part) SELECT p_partkey, 'text' AS token_class, CAST(0 AS BIGINT) AS start, CAST(n + 4 AS BIGINT) AS end, b || '/' || z || '双' AS original_text FROM t UNION ALL SELECT p_partkey, 'delimiter_segment', 0, CASE WHEN branded THEN n - 2 ELSE n END, CASE WHEN branded THEN left(b, n - 2) ELSE b END FROM t UNION ALL SELECT p_partkey, 'positive_integer_quantity', n + 1, n + 3, z FROM t UNION ALL SELECT p_partkey, 'shoe_size_like_numeric_segment', n + 1, n + 3, z FROM t WHERE sized UNION ALL SELECT p_partkey, 'shoe_size_like_numeric_segment', n - 2, n, right(b, 2) FROM t WHERE branded")
def evidence_spans(spark, sf_dir):
    return part_spans(spread(spark, sf_dir, "part", "p_partkey"))


@query("SELECT event_id, 'items[' || i || '].k' AS value_path, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events, (VALUES ('0'), ('1')) v(i)")
def structured_path_values(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"items": ['), "props", F.lit(", "), "props", F.lit(', {"z": 1}]}')).alias("payload"))
    return V.values_at_path(e, "payload", "items[].k").select("event_id", "value_path", "value")


@query("WITH t AS (SELECT p_partkey, 'span-' || left(sha256('contents[0].data.name' || chr(0) || '0' || chr(0) || length(p_name) || chr(0) || 'text'), 20) AS a, CASE WHEN p_size BETWEEN 25 AND 59 THEN 1 ELSE 0 END AS sized, 'task.documents[1].contents[2].data.name' || chr(0) || '0' || chr(0) || length(CAST(p_size AS VARCHAR)) || chr(0) AS b FROM part) SELECT p_partkey, CAST(2 AS BIGINT) AS n_text, CAST(0 AS BIGINT) AS n_delimiter_segment, CAST(1 AS BIGINT) AS n_positive_integer_quantity, CAST(sized AS BIGINT) AS n_shoe_size_like_numeric_segment, CAST(1 AS BIGINT) AS excluded_non_business, CAST(1 AS BIGINT) AS excluded_unselected_business, sha256(a || chr(0) || 'span-' || left(sha256(b || 'text'), 20) || chr(0) || 'span-' || left(sha256(b || 'positive_integer_quantity'), 20) || CASE WHEN sized = 1 THEN chr(0) || 'span-' || left(sha256(b || 'shoe_size_like_numeric_segment'), 20) ELSE '' END) AS evidence_sha256 FROM t")
def evidence_build(spark, sf_dir):
    leaf = lambda path, c: F.struct(F.lit(path).alias("path"), c.cast("string").alias("value"))
    leaves = load(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(leaf("contents[0].data.name", F.col("p_name")), leaf("contents[0].data.type", F.col("p_type")), leaf("task.documents[1].contents[2].data.name", F.col("p_size")), leaf("other", F.col("p_brand")))).alias("l")).select("p_partkey", "l.*")
    return V.build_evidence(leaves, ["p_partkey"], {"name": "contents[].data.name", "type": "contents[].data.type"}, ["name"])


TOKENS_SQL = "v AS (SELECT p_partkey, p_size, CASE p_size % 5 WHEN 0 THEN p_size || '' WHEN 1 THEN p_size || '.5' WHEN 2 THEN p_name || ';' || p_size WHEN 3 THEN ' ' ELSE translate(p_size || '', '0123456789', '０１２３４５６７８９') END AS value FROM part)"


@query(f"WITH {TOKENS_SQL} SELECT p_partkey, value, p_size % 5 <> 3 AS is_text, p_size % 5 IN (0, 4) AS is_quantity, p_size % 5 IN (0, 1, 4) AND p_size >= 25 AS is_size FROM v")
def token_classes(spark, sf_dir):
    size, kind = F.col("p_size").cast("string"), F.col("p_size") % 5
    value = F.when(kind == 0, size).when(kind == 1, F.concat(size, F.lit(".5"))).when(kind == 2, F.concat("p_name", F.lit(";"), size)).when(kind == 3, " ").otherwise(F.translate(size, "0123456789", "０１２３４５６７８９"))
    values = load(spark, sf_dir, "part").select("p_partkey", value.alias("value"))
    of = lambda c, n: V.matches_class(F.col("value"), F.lit(c)).alias(n)
    return values.select("p_partkey", "value", of("text", "is_text"), of("positive_integer_quantity", "is_quantity"), of("shoe_size_like_numeric_segment", "is_size"))


@query("SELECT doc_id, kind, count(*) AS n, CAST(sum(m) AS BIGINT) AS n_spans FROM (SELECT doc_id, 'line' AS kind, 1 AS m FROM documents, LATERAL (SELECT unnest(regexp_extract_all(text, '[^\\r\\n]+')) AS l) WHERE trim(l) <> '' UNION ALL SELECT doc_id, 'repeated_line_or_array_group', count(*) FROM documents, LATERAL (SELECT unnest(regexp_extract_all(text, '[^\\r\\n]+')) AS l) WHERE trim(l) <> '' GROUP BY doc_id, trim(regexp_replace(l, '\\s+', ' ', 'g')) HAVING count(*) > 1) GROUP BY doc_id, kind")
def evidence_line_groups(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = V.grouped_spans(V.line_spans(docs, F.lit("contents[0].text"), "text"), ["doc_id"], [])
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.size("span_ids")).cast("bigint").alias("n_spans"))


# ---- declarative rules and parsing ----

TEXT_STEPS = [{"op": "split", "source": "text", "delimiter": " ", "targets": ["product", "sales_attr1"]}, {"op": "strip_prefix", "source": "brand", "target": "sales_attr2", "literal": "Brand#"}, {"op": "to_positive_int", "source": "size", "target": "quantity"}]


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS product, substr(p_name, length(split_part(p_name, ' ', 1)) + 2) AS sales_attr1, CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE '' END AS sales_attr2, p_size AS quantity, 'draft' AS status FROM part")
def text_pipeline_profile(spark, sf_dir):
    start = {"text": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size").cast("string")}
    return U.run_steps(load(spark, sf_dir, "part"), start, TEXT_STEPS).select("p_partkey", "product", "sales_attr1", "sales_attr2", "quantity", "status")


@query("SELECT event_id, event_type AS product, CASE WHEN TRY_CAST(k AS INT) BETWEEN 1 AND 100000 THEN TRY_CAST(k AS INT) END AS quantity, CASE WHEN TRY_CAST(k AS INT) BETWEEN 1 AND 100000 THEN 'draft' ELSE 'needs_review' END AS status, CASE WHEN TRY_CAST(k AS INT) BETWEEN 1 AND 100000 THEN '' ELSE 'missing_quantity' END AS review_reason FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)")
def structured_profile(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return U.run_steps(e, {"product": F.col("event_type"), "quantity": F.get_json_object("props", "$.k")}, [], {"remark": "none", "quantity": 1}).select("event_id", "product", "quantity", "status", "review_reason")


@query("SELECT conv_id, coalesce(max(CASE WHEN role = 'user' AND rn = 1 THEN text END), '') AS first_user, coalesce(max(CASE WHEN role = 'assistant' AND rn = 2 THEN text END), '') AS second_assistant FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id")
def source_projection_profile(spark, sf_dir):
    return S.nth_per_class(load(spark, sf_dir, "conversations"), ["conv_id"], "role", ["turn"], "text", {"first_user": ("user", 0), "second_assistant": ("assistant", 1)})


@query("SELECT conv_id, CASE WHEN count(DISTINCT r) = 0 THEN 'format_profile_missing' WHEN count(DISTINCT r) > 1 THEN 'profile_ambiguous' ELSE 'parsed' END AS status, CASE WHEN count(DISTINCT r) = 1 THEN CAST(max(turn) FILTER (WHERE r IS NOT NULL) AS BIGINT) END AS turn FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR conv_id % 5 = 0 THEN NULL ELSE role END AS r FROM conversations) GROUP BY conv_id")
def profile_resolution(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").withColumn("r", F.when(~((F.col("turn") % 3 == 0) | (F.col("conv_id") % 5 == 0)), F.col("role")))
    return U.resolve_profiles(c, ["conv_id"], "turn", "r")


@query("SELECT l_orderkey AS o_orderkey, bool_and(l_returnflag <> 'R') AS complete FROM lineitem GROUP BY l_orderkey")
def parent_completeness(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "").otherwise("p").alias("product"), F.lit(1).alias("quantity"), F.lit("a").alias("sales_attr1"), F.lit("b").alias("sales_attr2"))
    return U.completeness(rows, ["l_orderkey"]).select(F.col("l_orderkey").alias("o_orderkey"), "complete")


@query(r"SELECT conv_id, turn, CAST(i - 1 AS INT) AS item_order, item FROM (SELECT conv_id, turn, unnest(x) AS item, generate_subscripts(x, 1) AS i FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(text, ',', ';'), ';(\s*[0-9])', chr(1) || '\1', 'g'), '[\r\n;]+'), lambda t: replace(trim(regexp_replace(t, '\s+', ' ', 'g')), chr(1), ';')), lambda t: t <> '' AND lower(t) <> 'auto') AS x FROM conversations))")
def item_split_explode(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").withColumn("text", F.replace("text", F.lit(","), F.lit(";")))
    return c.select("conv_id", "turn", F.posexplode(A.split_items(F.col("text"))).alias("item_order", "item"))


@query("SELECT doc_id, CASE WHEN contains(text, 'password') THEN 'secret' WHEN contains(text, 'rights') THEN 'licence' WHEN contains(text, 'the') THEN 'english' END AS reason FROM documents")
def special_keyword(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", A.special_reason(F.col("text"), [("password", "secret"), ("rights", "licence"), ("the", "english")]).alias("reason"))


@query("SELECT p_partkey, p_name AS product, p_brand AS sales_attr1, CAST(20 + p_size % 30 AS VARCHAR) AS sales_attr2, CAST(2 AS BIGINT) AS quantity, 'draft' AS status FROM part")
def heuristic_parse(spark, sf_dir):
    part = spread(spark, sf_dir, "part", "p_partkey")
    size = (F.col("p_size") % 30 + 20).cast("string")
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("【"), "p_name", F.lit("】"), "p_brand", F.lit("/"), size, F.lit(" *2"))).otherwise(F.concat("p_name", F.lit("，"), "p_brand", F.lit("，"), size, F.lit("码 x2")))
    return A.parse_items(part.withColumn("item", t), "item").select("p_partkey", "product", "sales_attr1", "sales_attr2", "quantity", "status")
