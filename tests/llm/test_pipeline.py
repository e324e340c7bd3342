"""The corpus pipeline's stages, each on what the one before kept."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tallyloom.llm import decontaminate, jaccard_join, secrets, toxicity
from tallyloom.llm.common import table, written


@pytest.fixture(scope="module")
def stages(spark, data):
    out, docs = [], table(spark, data, "documents")
    for _, stage in P.STAGES:
        out.append((docs, docs := written(stage(spark, docs, data))))
    return out


def test_stages_take_effect(spark, data, stages):
    documents = table(spark, data, "documents").columns
    assert all(after.columns == documents for _, after in stages[:-1])
    (all_, clean), (_, single), (_, fresh), (_, masked), (_, ids) = stages
    rejected = all_.join(clean, "doc_id", "left_anti")
    labels = table(spark, data, "labels")
    assert rejected.join(labels.where("toxic = 0"), "doc_id").count() <= 0.02 * all_.count()
    again = jaccard_join.join(single)
    assert again.where("n_links > 0").count() == 0 and single.count() == jaccard_join.join(clean).select("class_id").distinct().count()
    found = decontaminate.digest(decontaminate.find(single, table(spark, data, "benchmark")))
    assert fresh.count() == found.where("not contaminated").count()
    assert fresh.count() == masked.count() == ids.count()
    assert secrets.digest(secrets.find(masked)).where("n_access + n_hex > 0").count() == 0
    assert ids.where("not lossless").count() == 0


def test_run_gives_the_last_stage(spark, data, stages):
    got = P.run(spark, data)
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == sorted((r.doc_id, r.ids) for r in stages[-1][1].collect())


def test_odd_rows_pass(spark, data):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "password=abcdefgh12345", None, None, 21)]
    docs = spark.createDataFrame(rows, table(spark, data, "documents").schema)
    for _, stage in P.STAGES:
        docs = written(stage(spark, docs, data))
    got = {r.doc_id: r for r in docs.collect()}
    assert sorted(got, key=str) == [1, 2, 3, None] and docs.count() == 4 and got[2].ids == [] and got[None].ids is None


def test_clashing_columns_pass_unchanged(spark, data):
    names = ["score", "n_tokens", "expected", "spans", "n_words", "hits", "items", "digest", "stays", "found", "__sha", "N_Words2"]
    docs = table(spark, data, "documents").limit(40)
    wide = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for _, stage in P.STAGES[:-1]:
        wide = written(stage(spark, wide, data))
    rows = wide.collect()
    assert wide.columns == [*docs.columns, *names] and rows and all(r[n] == i for r in rows for i, n in enumerate(names))


def test_thresholds_are_the_stated_ones():
    assert (toxicity.THRESHOLD, jaccard_join.SHINGLE, jaccard_join.THRESHOLD, decontaminate.WINDOW) == (0.3, 5, 0.8, 10)
    assert re.fullmatch(r"[a-z_]+", P.STAGES[0][0])
