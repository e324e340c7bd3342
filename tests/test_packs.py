"""Versioned packs: atomic commits, writers in each other's way, and the life cycle from a sample to rows."""

import threading

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import batch as B
from tallyloom.sources import packs as K

PACK = {"code": "p", "name": "n", "version": "1", "parser_policy": {"order_row_parser": "declarative_v1", "fingerprint_strategy": "business_shape_v2", "format_profiles": []}}
DOC = '{"task":{"documents":[{"contents":[{"data":{"packageItemDetail":[{"itemName":"%s","itemNum":"2"}]}}]}]}}'


@pytest.fixture
def store(spark, tmp_path):
    return K.PackStore(spark, f"file://{tmp_path}/packs")


def test_second_writer_of_a_version_conflicts_and_retries(spark, store):
    assert store.current() == K.Version(0, {}, {})
    base = store.current()
    one = store.commit(base, {"a": 1}, {"t": spark.range(3)})
    with pytest.raises(K.Conflict):
        store.commit(base, {"a": 2}, {"t": spark.range(9)})
    assert store.current() == one and store.table(one, "t", "id long").count() == 3
    two = store.update(lambda v: (v.meta | {"b": 2}, {}))
    assert two.number == 2 and two.tables == one.tables and two.meta == {"a": 1, "b": 2}
    assert store.version(1) == one  # readers of the version before keep it


def test_many_writers_lose_nothing(store):
    def add(name):
        store.update(lambda v: (v.meta | {name: True}, {}), tries=50)

    threads = [threading.Thread(target=add, args=(f"w{i}",)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert set(store.current().meta) == {f"w{i}" for i in range(6)} and store.current().number == 6


def test_broken_manifest_does_not_count(spark, store, tmp_path):
    one = store.commit(store.current(), {"a": 1}, {})
    (tmp_path / "packs/_manifests/00000002.json").write_text('{"meta": ')
    assert K.PackStore(spark, store.path).current() == one


def test_learn_replay_activate_rerun(spark, store):
    from tallyloom.operators.fingerprint import fingerprints

    records = spark.createDataFrame([(1, 1, "c", DOC % "鞋"), (1, 2, "c", DOC % "帽")], "task_id long, record_id long, component string, payload string")
    K.activate(store, PACK, [])
    before = B.parse_batch(records, K.pack_of(store, store.current()))
    assert {r.reason for r in before.diagnostics.collect()} == {"format_profile_missing"}
    mark = fingerprints(records, "payload", "component", "business_shape_v2").first().fingerprint
    profile = {"strategy": "structured_items_v1", "fingerprint": mark, "items_path": "task.documents[].contents[].data.packageItemDetail[]", "fields": {"product": "itemName", "quantity": "itemNum"}, "defaults": {"sales_attr1": "-", "sales_attr2": "-"}}
    docs = records.select(F.col("record_id").alias("id"), "payload", F.lit(mark).alias("fingerprint"), F.lit("").alias("grammar"))
    want = spark.createDataFrame([(1, ["鞋|-|-|2|"]), (2, ["帽|-|-|3|"])], "id long, rows array<string>")
    version, summary = K.learn(store, docs, "id", profile, want)
    assert (summary["passed"], summary["ok"], version.number) == (1, False, 1)
    want = want.withColumn("rows", F.transform("rows", lambda r: F.replace(r, F.lit("|3|"), F.lit("|2|"))))
    version, summary = K.learn(store, docs, "id", profile, want)
    assert summary["ok"] and version.number == 2
    after = B.parse_batch(records, K.pack_of(store, version))
    assert sorted((r.record_id, r.product, r.quantity) for r in after.rows.collect()) == [(1, "鞋", 2), (2, "帽", 2)]
    again, _ = K.learn(store, docs, "id", profile, want)  # the same slot: replaced, with the next revision
    assert [r.revision for r in store.table(again, "profiles", K.PROFILES).collect()] == [2]
    with pytest.raises(ValueError, match="invalid pack"):
        K.activate(store, {"code": "x"})
