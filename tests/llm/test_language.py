"""Language identification: held-out accuracy on the given tables, vectors against a plain count, and odd inputs."""

import collections

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import language
from tallyloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, score string, rejected int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op13_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 0.02 * len(got)


def test_histograms_count_each_gram():
    texts = [b"", b" \n", b"A-b", "Été 12 été".encode(), b"x" * 5000, bytes(range(256))]
    got = language.histograms(texts)

    def bucket(gram):
        v = len(gram)
        for b in gram:
            v = (v << 8 ^ b) & 0xFFFFFFFF
        return v * 0x9E3779B1 % (1 << 32) >> 32 - language.BITS

    for row, t in zip(got, texts, strict=True):
        clean = b" " + b" ".join(t.translate(language._LETTERS).split()) + b" "
        want = collections.Counter(bucket(clean[i : i + n]) for n in language.SIZES for i in range(len(clean) - n + 1))
        assert dict(want) == {int(k): int(row[k]) for k in np.flatnonzero(row)}


def test_odd_texts_rows_and_columns(spark):
    base = [("the cat and the other thing was there", "en"), ("der Hund und die Katze sind nicht hier", "de")]
    rows = [(i, f"{t} {'again ' * (i % 3)}", g, "own", 7) for i in range(40) for t, g in base]
    odd = [(None, "the thing with the", None, "own", 7), (500, None, "en", "own", 7), (501, "", "de", "own", 7), (502, "123 -- !", None, "own", 7), (503, "the other thing", None, "own", 7), (503, "the other thing", None, "own", 7), (504, "нет", "ru", "own", 7), (505, "und nicht die " * 50_000, None, "own", 7)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    model = language.learn(df)
    got = language.identify(df, model, keep=["doc_id", "text", "lang"]).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.lang in ("en", "de"):
            assert r.lang_pred == r.lang
        assert r.lang_pred in ("en", "de", "ru", "und") and 0 <= r.score <= 1
    assert {r.lang_pred for r in got if r.doc_id == 505} == {"de"}
    assert {r.lang_pred for r in got if r.doc_id == 503} == {"en"}
    # labels of held-out rows change nothing
    turned = df.withColumn("lang", F.when(language.held_out("doc_id"), "xx").otherwise(F.col("lang")))
    again = language.learn(turned)
    assert again["langs"] == model["langs"] and np.array_equal(again["centres"], model["centres"])


def test_rejection_by_distance(spark):
    df = spark.createDataFrame([(i, "the cat and the other thing was there", "en", "", 0) for i in range(9)] + [(100, "zzqx qqzj xxjq", None, "", 0)], SCHEMA)
    got = {r.doc_id: r for r in language.identify(df, language.learn(df), keep=["doc_id"]).collect()}
    assert got[100].rejected and not got[0].rejected and got[100].lang_pred == "en"


def test_empty_and_unlabelled_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identify(empty, language.learn(empty)).collect() == []
    plain = spark.createDataFrame([(1, "some text", None, "", 0)], SCHEMA)
    assert [r.lang_pred for r in language.identify(plain, language.learn(plain)).collect()] == ["und"]


def test_clusters_are_far_apart_and_reach_their_members():
    r = np.random.default_rng(1)
    centres = np.eye(12)[:3]
    rows = np.abs(centres[r.integers(0, 3, 90)] + r.normal(0, 0.05, (90, 12)))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    found, reach = language.clustered(rows, 3)
    assert len(found) == 3 and sorted(found.argmax(1).tolist()) == [0, 1, 2]
    assert np.mean((rows @ found.T).max(1) >= reach[(rows @ found.T).argmax(1)]) >= 0.95
