"""Order rows, rules and dimensions over the given tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.match import five_fields

#: Keyword rules over product names: id, keyword, match type, priority, product, SKU, image.
RULES = [
    {"id": 1, "product_keyword": "ring", "product_match_fields": ["product"], "product_match_type": "contains", "priority": 10, "product_id": 1, "sku_match_fields": ["sales_attr1"]},
    {"id": 2, "product_keyword": "bolt", "product_match_fields": ["product"], "product_match_type": "contains", "priority": 20, "product_id": 2},
    {"id": 3, "product_keyword": "red", "product_match_fields": ["product", "remark"], "product_match_type": "contains", "priority": 5, "product_id": 3},
    {"id": 4, "product_keyword": "new widget", "product_match_fields": ["product"], "product_match_type": "exact", "priority": 1, "product_id": 4, "sku_id": 41},
    {"id": 5, "product_keyword": "anvil", "product_match_fields": ["product"], "product_match_type": "contains", "priority": 30, "product_id": 5, "image_asset_id": 7},
    {"id": 6, "product_keyword": "plate", "product_match_fields": ["product"], "product_match_type": "contains", "priority": 40, "product_id": 6, "is_enabled": False},
]
PRODUCTS = {1: "Ring", 2: "Bolt", 3: "Red goods", 4: "Widget", 5: "Anvil"}
WINDOWS = [(1, "2024-01-01 00:00:00", "2024-01-08 00:00:00"), (2, "2024-01-05 00:00:00", "2024-01-12 12:00:00"), (3, "2024-01-20 00:00:00", None)]
NO_VALUES = "cast(null as string)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt by its key, for work that takes long for each row: a small file is read by one task or a few, however many rows it has."""
    return load(spark, sf_dir, name).repartition(key)


def _cell(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "CAST('" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "' AS VARCHAR)"
    return str(v).lower() if isinstance(v, bool) else f"CAST({v} AS BIGINT)"


def cases_sql(names: str, rows: list[tuple], own: str = "甲") -> str:
    """SQL of parts with the values `names` of the case that each is dealt; `own` in a text stands for the part's name, with hyphens for its spaces."""
    cols = names.split(", ")
    shown = [f"replace({c}, '{own}', replace(p_name, ' ', '-')) AS {c}" if any(isinstance(r[i], str) for r in rows) else c for i, c in enumerate(cols)]
    values = ", ".join("(" + ", ".join(map(_cell, (i, *r))) + ")" for i, r in enumerate(rows))
    return f"SELECT p_partkey, {', '.join(shown)} FROM part JOIN (VALUES {values}) v(i, {names}) ON p_partkey % {len(rows)} = i"


def cases(spark: SparkSession, sf_dir: str, texts: list[str], name: str = "item", own: str = "甲") -> DataFrame:
    """All parts (p_partkey) with the text of the case that each is dealt, in which the part's name, with hyphens for its spaces, stands for `own`."""
    of = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % len(texts) + 1).cast("int"))
    return spread(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.replace(of, F.lit(own), F.replace("p_name", F.lit(" "), F.lit("-"))).alias(name))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as order rows with the five fields: part gives product and attributes."""
    line, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    rows = line.join(part, line["l_partkey"] == part["p_partkey"])
    return five_fields(rows, {"product": "p_name", "sales_attr1": "p_type", "sales_attr2": F.col("p_size").cast("string"), "quantity": F.col("l_quantity").cast("int").cast("string"), "remark": "l_returnflag"})


def skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SKU for each product and brand, with brand and type as terms."""
    part = load(spark, sf_dir, "part")
    found = part.select("p_brand", "p_type").distinct()
    product = F.explode(F.array(*[F.lit(p).cast("bigint") for p in PRODUCTS])).alias("product_id")
    return found.select("p_brand", "p_type", product).groupBy("product_id", "p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("types")).select("product_id", F.col("p_brand").alias("sku_id"), F.concat(F.array("p_brand"), "types").alias("terms"))
