"""Language identification by nearest centroids.

A text is a vector of hashed letter n-grams, weighted by (1 + log tf) * idf and normalised. Document frequencies are counted over all
training texts. Each language gets a few centroids from spherical k-means over a bounded sample of its training texts, and a text goes
to the language of the centroid with the largest cosine. A text that is much farther from it than the centroid's own members are is
marked as rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import col, map_texts, slices, written
from tallyloom.llm.toxicity import held_out

#: Hash buckets of n-grams, 2 ** BITS, and the n of them.
BITS = 13
SIZES = (1, 2, 3)
#: Training texts of each language that k-means sees, those of least hash; its centroids and rounds. Counts come from all texts.
SAMPLE, CENTROIDS, ROUNDS = 1_000, 4, 10
#: A text is rejected if its cosine is below so much of the cosine that 99 % of the centroid's members reach.
REJECT = 0.5
UNDETERMINED = "und"
#: Bytes of text whose vectors are made at once, and texts.
TOGETHER, ROWS = 256_000, 64

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case and bytes of longer characters; all else is space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def histograms(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text. Words are set off by single spaces."""
    clean = [b" " + b" ".join(t.translate(_LETTERS).split()) + b" " for t in texts]
    data = np.frombuffer(b"".join(clean), np.uint8).astype(np.uint32)
    of = np.repeat(np.arange(len(clean)), [len(t) for t in clean])
    out = np.zeros(len(clean) << BITS, np.int64)
    for n in SIZES:
        gram = np.full(max(len(data) - n + 1, 0), n, np.uint32)
        for k in range(n):
            gram = (gram << np.uint32(8)) ^ data[k : k + len(gram)]
        inside = of[: len(gram)] == of[n - 1 : n - 1 + len(gram)]
        bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        out += np.bincount(((of[: len(gram)] << BITS) + bucket)[inside], minlength=len(out))
    return out.reshape(len(clean), -1)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised weights of rows of counts; rows without any stay zero."""
    weights = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    norm = np.linalg.norm(weights, axis=1, keepdims=True)
    return weights / np.where(norm > 0, norm, 1)


def _groups(texts: list[bytes]):
    for lo, hi in slices([len(t) for t in texts], TOGETHER):
        for k in range(lo, hi, ROWS):
            yield k, min(hi, k + ROWS)


# ---- fit ----


def _statistics(batches):
    """Document frequencies of the task's texts in a row of their own, and the counts of the sampled texts in a row each."""
    frequency = np.zeros(1 << BITS, np.int64)
    schema = ["lang", "hash", "buckets", "counts"]
    for batch in batches:
        langs, hashes, sampled = (batch.column(k).to_pylist() for k in (0, 1, 2))
        texts = batch.column(3).cast(pa.binary()).to_pylist()
        rows: list[list] = [[], [], [], []]
        for lo, hi in _groups(texts):
            counts = histograms(texts[lo:hi])
            frequency += (counts > 0).sum(0)
            for k in range(lo, hi):
                if sampled[k]:
                    at = np.flatnonzero(counts[k - lo])
                    for to, v in zip(rows, (langs[k], hashes[k], at, counts[k - lo][at]), strict=True):
                        to.append(v)
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int64())), pa.array(rows[3], pa.list_(pa.int64()))], schema)
    if frequency.any():
        at = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([at], pa.list_(pa.int64())), pa.array([frequency[at]], pa.list_(pa.int64()))], schema)


def clustered(rows: np.ndarray, most: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids, started far apart, and the cosine that 99 % of each one's members reach."""
    start = [int((rows @ rows.mean(0)).argmax())]
    while len(start) < min(most, len(rows)):
        closest = (rows @ rows[start].T).max(1)
        if closest.min() > 1 - 1e-6:
            break
        start.append(int(closest.argmin()))
    centres = rows[start]
    for _ in range(rounds):
        of = (rows @ centres.T).argmax(1)
        sums = np.stack([rows[of == k].sum(0) if (of == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    near = rows @ centres.T
    of = near.argmax(1)
    kept = [k for k in range(len(centres)) if (of == k).any()]
    return centres[kept], np.array([np.quantile(near[of == k, k], 0.01) for k in kept])


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Inverse document frequencies, and centroids with their languages and reach, from rows with text and language that aren't held out.

    The model is 2 ** BITS numbers for each of CENTROIDS centroids of a language, whatever the number of rows."""
    text, lang = col(text_col).cast("string"), col(lang_col).cast("string")
    train = df.where(~held_out(id_col) & text.isNotNull() & lang.isNotNull()).select(lang.alias("lang"), F.xxhash64(col(id_col).cast("string"), text).alias("hash"), text.alias("text"))
    # a language's sample: its texts of least hash; a third of all rows may be one row, so equal ones count once. Only about four
    # times as many as are wanted meet in one place, whatever the number of texts.
    hashes = written(train.select("lang", "hash").distinct())
    share = F.broadcast(hashes.groupBy("lang").agg((4.0 * SAMPLE / F.count("*")).alias("share")))  # a row for each language
    near = hashes.join(share, "lang").where((F.col("hash").cast("double") / 2.0**64 + 0.5) <= F.col("share"))
    least = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("k") <= SAMPLE)
    cut = {r.lang: r for r in least.groupBy("lang").agg(F.max("hash").alias("most")).collect()}
    if not cut:
        return {"idf": np.zeros(1 << BITS, np.float32), "langs": [], "centres": np.zeros((0, 1 << BITS), np.float32), "reach": np.zeros(0)}
    cuts = df.sparkSession.createDataFrame([(k, r.most) for k, r in cut.items()], "lang string, most long")
    marked = train.join(F.broadcast(cuts), "lang").select("lang", "hash", (F.col("hash") <= F.col("most")).alias("sampled"), "text")
    found = written(marked.mapInArrow(_statistics, "lang string, hash long, buckets array<long>, counts array<long>"))

    frequency = np.zeros(1 << BITS)
    each = F.explode(F.arrays_zip("buckets", "counts")).alias("s")
    for r in found.where("lang is null").select(each).groupBy("s.buckets").agg(F.sum("s.counts").alias("n")).collect():
        frequency[r.buckets] = r.n
    total = train.count()
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float32)

    def fit(key, group):
        counts = np.zeros((len(group), 1 << BITS), np.int64)
        order = np.argsort(group["hash"].to_numpy(), kind="stable")
        for k, at in enumerate(order.tolist()):
            counts[k, group["buckets"][at].values.to_numpy()] = group["counts"][at].values.to_numpy()
        centres, reach = clustered(vectors(counts, idf))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(centres), pa.string()), "reach": pa.array(reach.astype(float)), "centre": pa.array(list(centres.astype(np.float32)), pa.list_(pa.float32()))})

    sample = found.where("lang is not null").dropDuplicates(["lang", "hash"])
    rows = sorted(sample.groupBy("lang").applyInArrow(fit, "lang string, reach double, centre array<float>").collect(), key=lambda r: (r.lang, r.reach, r.centre))
    return {"idf": idf, "langs": [r.lang for r in rows], "centres": np.array([r.centre for r in rows], np.float32), "reach": np.array([r.reach for r in rows])}


# ---- prediction ----


def judged(texts: list[bytes], model: dict) -> list[tuple]:
    """(lang_pred, score, cosine, rejected) of each text."""
    names = sorted(set(model["langs"]))
    owner = np.array([names.index(x) for x in model["langs"]])
    out = []
    for lo, hi in _groups(texts):
        near = vectors(histograms(texts[lo:hi]), model["idf"]) @ model["centres"].T
        for text, cosines in zip(texts[lo:hi], near, strict=True):
            if not names or not _LETTER.search(text.decode(errors="replace")):
                out.append((UNDETERMINED, 0.0, 0.0, True))
                continue
            k = int(cosines.argmax())
            first, rest = float(cosines[k]), cosines[owner != owner[k]]
            second = float(max(rest.max(), 0)) if len(rest) else 0.0
            score = min(max(first / (first + second), 0.0), 1.0) if first > 0 else 0.0
            out.append((model["langs"][k], score, first, first < REJECT * model["reach"][k]))
    return out


def identify(df: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep` with lang_pred, score (0 to 1), cosine and rejected.

    lang_pred is the language of the nearest centroid, `und` where a text is null or has no letter, or where nothing was learnt.
    The score is the nearest cosine's share of the sum of it and the nearest of another language, 0 for `und`. rejected marks texts too
    far from their centroid; they keep the nearest language, and callers that want none for them look at it. Texts of any length
    count whole, repeated rows come back each, ties go to the language first in order, and an empty table gives no rows."""
    out = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cosine", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    shared = df.sparkSession.sparkContext.broadcast(model)  # of a size that only the number of languages decides

    def make():
        return lambda texts: dict(zip(out.names, zip(*judged(texts, shared.value), strict=True), strict=True))

    return map_texts(df, text_col, df.columns if keep is None else keep, out, make)
