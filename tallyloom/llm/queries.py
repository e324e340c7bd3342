"""The queries over the given tables that apply each operator with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import collocations, decontaminate, hmm, jaccard_join, language, licenses, pieces, quality, repeats, secrets, spelling, toxicity, warc
from tallyloom.llm.common import table, work_dir
from tallyloom.llm.oracles import ORACLE_SQL


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    tagged = toxicity.tag(docs, toxicity.learn(docs, labels), keep=["doc_id"])
    return tagged.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_tokens", F.size("spans").cast("long").alias("n_spans"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check_col="lossless")
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return encoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), ids.alias("ids_sha256"), F.coalesce("lossless", F.lit(True)).alias("lossless"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    pages = table(spark, sf_dir, "pages")
    warc.build_index(warc.write_archives(pages, path), path)
    return warc.lookup(pages, path, with_payload=False).drop("payload", "url")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs), keep=["doc_id"])
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "lang_pred", "score", "cosine", "rejected")


# What the queries above return and SQL can express, as queries of their own.


def repeat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_repeats(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans")


def language_model_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_language_model(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round(F.col("base_score") * 1000).cast("long").alias("base_millis"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_warc": op3_warc,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_repeats": op5_repeats,
    "op6_decontaminate": op6_decontaminate,
    "op7_language_model": op7_language_model,
    "op8_licenses": op8_licenses,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "op11_spelling": op11_spelling,
    "op12_collocations": op12_collocations,
    "op13_language": op13_language,
    "repeat_counts": repeat_counts,
    "language_model_base": language_model_base,
    "license_base": license_base,
    "secret_counts": secret_counts,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
