"""The registered queries of workbooks, retention and their differences, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import batch as B
from tallyloom.operators import retention as Y
from tallyloom.operators import workbook as W
from tallyloom.plans.parsing import PACK, RECORDS_SQL, raw_records
from tallyloom.plans.registry import query
from tallyloom.plans.tables import load
from tallyloom.sources import packs as K
from tallyloom.sources.shared import work_folder

BOOK_SQL = """
WITH l AS (SELECT n_name AS stall, s_name, s_acctbal, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
body AS (SELECT stall AS sheet, row_number() OVER (PARTITION BY stall ORDER BY s_suppkey) + 1 AS row, [s_name, CASE WHEN s_acctbal < 0 THEN '''' ELSE '' END || CAST(CAST(s_acctbal AS DECIMAL(18, 2)) AS VARCHAR)] AS cells FROM l WHERE s_suppkey % 4 > 0),
head AS (SELECT DISTINCT sheet, 1 AS row, ['supplier', 'balance'] AS cells FROM body),
bad AS (SELECT 'exceptions' AS sheet, row_number() OVER (ORDER BY '面单 ' || s_suppkey) + 1 AS row, ['面单 ' || s_suppkey, s_name, '', '', '', '', 'product_unmatched'] AS cells FROM l WHERE s_suppkey % 4 = 0),
bad_head AS (SELECT DISTINCT sheet, 1 AS row, ['parent_label', 'product', 'sales_attr1', 'sales_attr2', 'quantity', 'remark', 'reason'] AS cells FROM bad)
SELECT 'report' AS book, sheet, row, array_to_string(cells, '|') AS cells FROM (SELECT * FROM body UNION ALL SELECT * FROM head UNION ALL SELECT * FROM bad UNION ALL SELECT * FROM bad_head)
"""


def supplier_books(spark, sf_dir, mode="stall_sheet"):
    rows = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    good, bad = rows.where("s_suppkey % 4 > 0"), rows.where("s_suppkey % 4 = 0")
    none = F.lit(None).cast("string")
    faults = bad.select(F.concat(F.lit("面单 "), "s_suppkey").alias("parent_label"), F.col("s_name").alias("product"), *[none.alias(c) for c in ("sales_attr1", "sales_attr2", "quantity", "remark")], F.lit("product_unmatched").alias("reason"))
    return W.report_books(good, faults, "n_name", ["s_suppkey"], {"supplier": F.col("s_name"), "balance": F.col("s_acctbal").cast("decimal(18,2)")}, mode)


@query(BOOK_SQL)
def report_book(spark, sf_dir):
    return supplier_books(spark, sf_dir).withColumn("cells", F.array_join("cells", "|"))


PARTS_SQL = "p AS (SELECT 'k' AS book, p_brand AS sheet, p_partkey AS n, p_partkey % 10 AS kind, [p_partkey || '', p_name, p_type, p_size || ''] AS cells, p_size FROM part)"


@query(f"WITH {PARTS_SQL} SELECT book, sheet, 'changed' AS kind, n AS row, 4 AS col, p_size || '' AS left_value, (p_size + 1) || '' AS right_value, CAST(NULL AS BIGINT) AS moved_to FROM p WHERE kind = 0 UNION ALL SELECT book, sheet, 'missing', n, i, cells[i], NULL, NULL FROM p, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE kind = 1 UNION ALL SELECT book, sheet, 'added', n, 6, NULL, 'x', NULL FROM p WHERE kind = 2 UNION ALL SELECT book, sheet, 'moved', n, NULL, NULL, NULL, n + 1000000 FROM p WHERE kind = 3")
def workbook_diff(spark, sf_dir):
    kind = F.col("p_partkey") % 10
    size = F.when(kind == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string")
    cells = lambda last: F.array(F.col("p_partkey").cast("string"), "p_name", "p_type", last, F.lit(" "), F.lit(None).cast("string"))
    part = load(spark, sf_dir, "part").select("*", F.lit("k").alias("book"), F.col("p_brand").alias("sheet"))
    left = part.select("book", "sheet", F.col("p_partkey").alias("row"), cells(F.col("p_size").cast("string")).alias("cells"))
    moved = F.when(kind == 3, F.col("p_partkey") + 1_000_000).otherwise(F.col("p_partkey"))
    right_cells = F.when(kind == 2, F.concat(F.slice(cells(size), 1, 4), F.array(F.lit(""), F.lit("x")))).otherwise(cells(size))
    right = part.where(kind != 1).select("book", "sheet", moved.alias("row"), right_cells.alias("cells"))
    return W.workbook_diff(left, right)


@query("WITH o AS (SELECT o_orderkey, o_orderdate, o_orderstatus = 'F' AND o_orderdate < DATE '1998-01-01' AS old FROM orders), gone AS (SELECT * FROM o WHERE old) SELECT 'orders' AS level, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM gone GROUP BY 2 UNION ALL SELECT 'lineitem', strftime(o_orderdate, '%Y-%m'), count(*) FROM gone JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 2")
def purge_counts(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    old = (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1998-01-01").cast("date"))
    levels = [Y.Level("orders", orders, "o_orderkey"), Y.Level("lineitem", load(spark, sf_dir, "lineitem"), "l_orderkey", "orders", "l_orderkey")]
    return Y.purge_counts(Y.tombstones(levels, old, F.date_format("o_orderdate", "yyyy-MM")))


@query(f"WITH {RECORDS_SQL} SELECT record_id, i AS row_index, CASE i WHEN 1 THEN p_name ELSE p_name || ' b' END AS product, 3 - i AS quantity, CAST(2 AS BIGINT) AS version FROM r, (SELECT unnest([1, 2]) AS i) WHERE kind < 2")
def learned_rows(spark, sf_dir):
    """A profile is learned from a part of the records (those of one task), activated by the commit, and all records are read again."""
    store = K.PackStore(spark, work_folder(spark, "packs"))
    K.activate(store, PACK, [])
    profile, records = PACK["parser_policy"]["format_profiles"][0], raw_records(spark, sf_dir)
    samples = records.where("task_id = 0").select(F.col("record_id").alias("id"), "payload", F.lit(profile["fingerprint"]).alias("fingerprint"), F.lit("").alias("grammar"))
    name = F.get_json_object("payload", "$.task.documents[0].contents[0].data.packageItemDetail[0].itemName")
    want = samples.select("id", F.array(F.concat(name, F.lit("|-|-|2|")), F.concat(name, F.lit(" b|-|-|1|"))).alias("rows"))
    version, _ = K.learn(store, samples, "id", profile, want)
    return B.parse_batch(records, K.pack_of(store, version)).rows.select("record_id", "row_index", "product", "quantity", F.lit(version.number).cast("bigint").alias("version"))
