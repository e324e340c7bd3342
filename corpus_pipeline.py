"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of docs. Rows with a
null id pass the near-duplicate stage; rows that repeat id and text count as copies there, and one stays. More columns may be
there under any names, and pass all stages but the last unchanged. run() deletes each written stage once the next one is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, jaccard_join, pieces, secrets, toxicity
from tallyloom.llm.common import remove, table, work_dir, written


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by their places, which no operator's results are named like, and those names."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    rows, names = _numbered(docs)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    tagged = toxicity.tag(rows, model, text_col=names["text"], keep=rows.columns)
    return tagged.where(F.col("score") < toxicity.THRESHOLD).select(*rows.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity connect, that with the smallest id stays."""
    rows, names = _numbered(docs)
    return jaccard_join.one_of_each(rows, names["doc_id"], names["text"]).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows, names = _numbered(docs)
    found = decontaminate.find(rows, table(spark, sf_dir, "benchmark"), text_col=names["text"], keep=rows.columns)
    return found.where(F.size("hits") == 0).select(*rows.columns).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars, where docs have it, follows."""
    rows, names = _numbered(docs)
    masked = secrets.redact(rows, text_col=names["text"])
    if "n_chars" in names:
        masked = masked.withColumn(names["n_chars"], F.char_length(names["text"]).cast("long"))
    return masked.select(*rows.columns).toDF(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of a sampled segmentation, and whether decoding gives the text back."""
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), check_col="lossless")
    return encoded.select("doc_id", "lang", "source", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.coalesce("lossless", F.lit(True)).alias("lossless"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top, before = table(spark, sf_dir, "documents"), work_dir(spark), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{top}/{name}")
        if before:
            remove(spark, top, before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
