"""Queries over rows that the given tables lack or that were once left out, against brute force."""

import hashlib

from pyspark.sql import functions as F

from tallyloom.plans import registry


def test_hash_chain_of_long_groups(spark, tmp_path):
    sizes = {1: 25_000, 2: 101, 3: 1}  # more than two Arrow batches, one row over the old bound, one row
    rows = spark.range(25_000).select(F.explode(F.array(*[F.lit(u) for u in sizes])).alias("user_id"), (F.lit(99_999) - F.col("id")).alias("event_id"))
    kept = rows.where(" or ".join(f"user_id = {u} and event_id > {99_999 - n}" for u, n in sizes.items())).withColumn("props", F.concat(F.lit("é"), F.col("event_id").cast("string")))
    kept.write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for u, n in sizes.items():
        h = ""
        for place, event in enumerate(range(100_000 - n, 100_000), 1):
            h = hashlib.sha256(f"{h}{place}\0{hashlib.sha256(f'é{event}'.encode()).hexdigest()}".encode()).hexdigest()
        want[u] = (n, h)
    assert {r.user_id: (r.n, r.chain) for r in registry.QUERIES["hash_chain"](spark, str(tmp_path)).collect()} == want


def test_sizes_are_repeated_over_all_stalls(spark, data):
    lines = registry.report_lines(spark, data)
    want = {}
    for r in lines.select("stall_name", "product_name", "spec", "image_id", "size_text", "n").collect():
        want.setdefault((r.stall_name, r.product_name, r.spec, r.image_id), []).extend([r.size_text] * r.n)
    assert len({k[0] for k in want}) > 3
    found = sorted((r.stall_name, r.product_name, r.spec, r.sizes) for r in registry.QUERIES["report_sizes_repeated"](spark, data).collect())
    assert found == sorted((*k[:3], " ".join(sorted(v, key=int)) + " ") for k, v in want.items())


def test_items_are_cut_at_semicolons(spark, tmp_path):
    texts = ["鞋 *1; 袜 *2；帽", "a;b\n c ;; d", "x", "颜色:黑; 2双"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {}
    for r in registry.QUERIES["item_split_explode"](spark, str(tmp_path)).orderBy("conv_id", "item_order").collect():
        got.setdefault(r.conv_id, []).append(r.item)
    assert got == {0: ["鞋 *1", "袜 *2", "帽"], 1: ["a", "b", "c", "d"], 2: ["x"], 3: ["颜色:黑; 2双"]}


def test_no_row_of_a_table_is_left_out(spark, data):
    for name, table, key in (("segment_split", "part", "p_partkey"), ("segment_split_documents", "documents", "doc_id"), ("evidence_spans", "part", "p_partkey")):
        keys = lambda df, key=key: {r[0] for r in df.select(key).distinct().collect()}
        assert keys(registry.QUERIES[name](spark, data)) == keys(spark.read.parquet(f"{data}/{table}.parquet")), name
    n = sum(spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("documents", "customer"))
    assert registry.QUERIES["safe_cell"](spark, data).count() == n


def test_projected_texts_are_whole(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {}
    for r in turns:
        want.setdefault(r.conv_id, {"user": [], "assistant": []}).setdefault(r.role, []).append(r.text)
    assert any(len(t) > 20 for v in want.values() for t in v["user"])
    got = {r.conv_id: (r.first_user, r.second_assistant) for r in registry.QUERIES["source_projection_profile"](spark, data).collect()}
    assert got == {k: ((v["user"] or [""])[0], (v["assistant"][1:] or [""])[0]) for k, v in want.items()}
