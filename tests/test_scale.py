"""Steps whose work grew faster than their rows, or stayed in the few tasks that a small file has."""

from pyspark.sql import functions as F

from tallyloom.operators import match as M


def rows_in(df, node: str) -> int:
    """The rows of the largest node of that kind that df's plan made when it ran."""
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    df.collect()
    todo = [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        if node in name and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().length())]
    return most


def test_scores_are_of_distinct_values(spark):
    """Two hundred rows of one value and forty SKUs with it: the scores are forty, not eight thousand."""
    skus = spark.range(40).select(F.lit(1).cast("bigint").alias("product_id"), F.col("id").alias("sku_id"), F.array(F.lit("red"), F.concat(F.lit("s"), "id")).alias("terms"))
    rows = spark.range(200).select("id", F.lit(1).cast("bigint").alias("product_id"), F.lit("Red").alias("a"), F.when(F.col("id") == 7, "S7").otherwise("").alias("b"))
    got = M.best_sku(rows, skus, ["id"], ["a", "b"])
    assert rows_in(got, "Join") < 500 and rows_in(got, "HashAggregate") < 500
    found = {r["id"]: (r["score"], r["n_best"], r["sku_id"]) for r in got.collect()}
    assert len(found) == 200 and set(found.values()) == {(10003, 40, None)}


def test_best_sku_of_a_row_that_stands_twice(spark):
    skus = spark.createDataFrame([(1, 1, ["red", "xl"]), (1, 2, ["red"]), (2, 3, ["blue"])], "product_id long, sku_id long, terms array<string>")
    rows = spark.createDataFrame([(1, 1, "red"), (1, 1, "large red"), (2, 2, "blu"), (3, 1, "green"), (4, 1, None), (5, 1, "XL"), (5, 1, "")], "id long, product_id long, a string")
    want = {tuple(r) for r in M.top_sku(M.sku_scores(rows, skus, ["id"], ["a"]), ["id"]).collect()}
    assert {tuple(r) for r in M.best_sku(rows, skus, ["id"], ["a"]).collect()} == want == {(1, 10003, 2, None), (2, 1003, 1, 3), (5, 10002, 1, 1)}


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_batches_work_out_fingerprints_and_faults_once(spark, data):
    """What a batch's results are made of is in work tables: no result walks payloads again for its documents."""
    from tallyloom.operators import batch as B
    from tallyloom.plans.parsing import PACK, raw_records

    got = B.parse_batch(raw_records(spark, data), PACK)
    assert plan_of(got.rows).count("try_parse_json") == 0 and plan_of(got.rows).count("Join") <= 4


def test_profiles_read_each_document_once(spark, data):
    from tallyloom.plans.parsing import PROFILES, profile_docs
    from tallyloom.operators import profiles as D

    for df in D.parse_profiles(profile_docs(spark, data), "p_partkey", PROFILES):
        assert plan_of(df).count("LogicalRDD") + plan_of(df).count("Relation [") <= len(PROFILES) + 1


def test_preferred_texts_meet_no_second_reading(spark):
    from tallyloom.operators.drafts import preferred_texts

    rows = spark.createDataFrame([(1, 0, "other"), (1, 1, "x.productInfo"), (1, 2, "x.productInfo"), (1, 3, "y.productInfo"), (2, 0, None)], "id int, place int, path string")
    got = preferred_texts(rows, ["id"], "path", ["place"])
    assert "Join" not in plan_of(got)
    assert {tuple(r) for r in got.collect()} == {(1, 1, "x.productInfo"), (1, 2, "x.productInfo")}


def test_rows_of_small_files_are_dealt(spark, data):
    from tallyloom.plans import parsing, registry

    dealt = [parsing.raw_records(spark, data), parsing.profile_docs(spark, data), parsing.nested_payloads(spark, data), parsing.samples(spark, data), registry.QUERIES["heuristic_parse"](spark, data), registry.QUERIES["evidence_spans"](spark, data)]
    assert all("RepartitionByExpression" in plan_of(df) for df in dealt)


def test_workbooks_are_not_broadcast(spark, data):
    from tallyloom.plans import books

    plan = books.workbook_diff(spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_pending_orders_meet_distinct_keys_once(spark, data):
    from tallyloom.plans import registry

    plan = plan_of(registry.pending_union(spark, data))
    assert plan.count("Join") == 1 and "Aggregate" in plan and "Union" not in plan
