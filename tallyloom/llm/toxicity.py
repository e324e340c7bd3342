"""Toxicity: a linear-chain conditional random field over tokens, whose marginals make document scores and offending offsets.

Labels are given for documents, so tokens are labelled first: a token of a toxic text is toxic if its features (the word, or
its beginning) stand in toxic training texts and hardly ever in others. The field has two states; a state's weight at a
token is the sum of its hashed features' weights, transitions have a weight each. It is trained by gradient ascent on the
likelihood of whole texts, each of which is one chain, and forward-backward over the whole text (chains.py) gives each token's
marginal. A logistic curve over sums of a document's marginals, fitted on training texts that the field hasn't seen, gives the
score.

The model is fitted on the driver from a bounded sample of the labelled training rows: for each label those with the smallest
hashes of their ids, SAMPLE rows and SAMPLE_BYTES bytes of whole texts at most. Every text is scored whole. Null and empty texts
have the score of a text without tokens. Repeated rows are scored alike. Ids may be of any type; kept columns with the name of a
result go.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.chains import Chains
from tallyloom.llm.common import LOWER_BYTES, col, map_texts, others

#: Labelled rows of each label that the model is fitted on, at most.
SAMPLE = 2500
#: Bytes of their texts for each label, at most; a text that goes beyond what is left of them is passed over.
SAMPLE_BYTES = 10_000_000
BUCKETS = 1 << 20
#: Least log-likelihood ratio of a feature that labels tokens; tens of thousands of features are tried.
WEAK_RATIO = 13.0
THRESHOLD = 0.3
#: Least marginal of a token that an offending span holds.
SPAN_LEAST = 0.5
_STRIP = bytes(b for b in range(33, 127) if not chr(b).isalnum())

OUT = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("expected", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())]))),
    ]
)


def tokens_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_BYTES).split()


def features(token: bytes) -> tuple[int, int, int]:
    """Buckets of the word without punctuation, its first four and its first five bytes."""
    w = token.strip(_STRIP)
    return zlib.crc32(b"w" + w) % BUCKETS, zlib.crc32(b"4" + w[:4] + b"." * (len(w) < 5)) % BUCKETS, zlib.crc32(b"5" + w[:5] + b"." * (len(w) < 6)) % BUCKETS


def chains(logits: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> Chains:
    """Texts whose tokens have log weights `logits` of state 1 (state 0 has 0); trans: log weights [from, to]."""
    weights = np.exp(np.clip(logits, -30, 30))
    return Chains(lengths, lambda at: np.stack([np.ones(len(at)), weights[at]], 1), np.ones(2), np.exp(trans))


def marginals(logits: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's probability of state 1, and the expected number of steps from state to state."""
    out, steps = np.zeros(len(logits)), np.zeros((2, 2))
    for at, share, _, moves, _ in chains(logits, lengths, trans).marginals():
        out[at] = share[:, 1]
        steps += moves
    return out, steps


def unlike(feats: list[np.ndarray]) -> np.ndarray:
    """Which texts to count: copies and near copies of an earlier text, by MinHash bands over word pairs, would make their words look toxic."""
    seen, keep = set(), np.ones(len(feats), bool)
    for i, f in enumerate(feats):
        w = f[:, 0].astype(np.uint64)
        pair = (w[:-1] * np.uint64(BUCKETS) + w[1:]) if len(w) > 1 else w
        bands = []
        for band in range(6):
            mins = [int(((pair + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * (2 * band + k) * 0x10001) >> np.uint64(24)).min()) if len(pair) else 0 for k in range(2)]
            bands.append((band, *mins))
        keep[i] = not any(b in seen for b in bands)
        seen.update(bands)
    return keep


def weak_labels(feats: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Buckets that mark tokens of toxic texts: 20 times likelier there than in others, with a log-likelihood ratio that chance does not reach."""
    seen = np.zeros((2, BUCKETS))
    for f, y in zip(feats, toxic, strict=True):
        seen[int(y)][np.unique(f)] += 1
    n = np.array([max(1, (toxic == y).sum()) for y in (0, 1)], float)
    part, whole = (seen + 1e-9) / n[:, None], (seen.sum(0) + 1e-9) / n.sum()
    ratio = (seen * np.log(part / whole)).sum(0)
    return (ratio > WEAK_RATIO) & (part[1] > 20 * (seen[0] + 0.1) / n[0])


def fit(rows: list[tuple[bytes, int]], steps: int = 25, rate: float = 0.3) -> dict:
    """The model from (text, label) rows; two thirds train the field, the others the document curve."""
    toxic = np.array([y for _, y in rows])
    cache: dict[bytes, tuple] = {}
    feats = [np.array([cache.get(w) or cache.setdefault(w, features(w)) for w in tokens_of(t)], np.int32).reshape(-1, 3) for t, _ in rows]
    del cache
    train = np.arange(len(rows)) % 3 != 2
    model = {"weights": np.zeros(BUCKETS, np.float32), "bias": -6.0, "trans": np.zeros((2, 2)), "curve": np.array([-5.0, 0.0, 0.0])}
    if not len(rows) or not 0 < toxic.sum() < len(rows):
        model["curve"][0] = 5.0 if len(rows) and toxic.all() else -5.0
        return model
    single = np.flatnonzero(train & unlike(feats))
    marked = weak_labels([feats[i] for i in single], toxic[single])
    flat = np.concatenate([feats[i] for i in single])
    lengths = np.array([len(feats[i]) for i in single])
    gold = marked[flat].any(1) & np.repeat(toxic[single] == 1, lengths)
    used = np.flatnonzero(np.bincount(flat.ravel(), minlength=BUCKETS))
    number = np.zeros(BUCKETS, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    place = number[flat]
    del flat
    inner = np.repeat(np.arange(len(lengths)), lengths)
    inner = inner[1:] == inner[:-1]
    w, bias, trans = np.zeros(len(used)), -3.0, np.zeros((2, 2))
    want = np.bincount((2 * gold[:-1] + gold[1:])[inner], minlength=4).reshape(2, 2).astype(float)
    count = lambda x: sum(np.bincount(place[:, k], x, len(used)) for k in range(3))
    n_want = count(gold.astype(float))
    s_w, s_b, s_t = np.full(len(used), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(steps):  # AdaGrad on the mean log-likelihood, with a small L2 penalty
        mu, moves = marginals(w[place[:, 0]] + w[place[:, 1]] + w[place[:, 2]] + bias, lengths, trans)
        g = n_want - count(mu) - 1e-3 * w
        gb, gt = float(gold.sum() - mu.sum()), want - moves - 1e-3 * trans
        s_w, s_b, s_t = s_w + g * g, s_b + gb * gb, s_t + gt * gt
        w, bias, trans = w + rate * 3 * g / np.sqrt(s_w), bias + rate * gb / np.sqrt(s_b), trans + 0.1 * gt / np.sqrt(s_t)
    model["weights"][used] = w
    model |= {"bias": float(bias), "trans": trans}
    rest = [i for i in range(len(rows)) if not train[i]]
    lengths = np.array([len(feats[i]) for i in rest])
    logits = model["weights"][np.concatenate([feats[i] for i in rest])].sum(1) + model["bias"]
    x = document_features(marginals(logits, lengths, model["trans"])[0], lengths)
    model["curve"] = logistic(x, toxic[rest])
    return model


def token_marginals(texts: list[list[bytes]], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all tokens, one text after the other, and the texts' lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64, int(lengths.sum()))
    buckets = np.array([features(w) for w in ids], np.int64).reshape(-1, 3)
    return marginals((model["weights"][buckets].sum(1) + model["bias"])[number], lengths, model["trans"])[0], lengths


def document_features(mu: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(1, log-odds of the largest marginal, log of the expected toxic tokens) of each text."""
    sums, most = np.zeros(len(lengths)), np.zeros(len(lengths))
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        sums[full], most[full] = np.add.reduceat(mu, starts), np.maximum.reduceat(mu, starts)
    most = np.clip(most, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(lengths)), np.log(most / (1 - most)), np.log(0.01 + sums)], 1)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method with an L2 penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """Labelled rows of each label, those with the smallest hashes of their ids: at most `sample` of them, and `sample_bytes` of text."""
    lab = labels.select(col(id_col).alias("__id"), col(label_col).cast("int").alias("__y")).where("__y in (0, 1) and __id is not null").dropDuplicates(["__id"])
    picked = None
    for y in (1, 0):
        part = lab.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    text = docs.select(col(id_col).alias("__id"), col(text_col).cast("string").alias("__t")).where(F.octet_length("__t") > 0)
    sizes = text.join(F.broadcast(picked), "__id").groupBy("__id", "__y").agg(F.sum(F.octet_length("__t")).alias("__n"))  # 2 * sample rows
    left, chosen = {0: sample_bytes, 1: sample_bytes}, []
    for i, y, n, _ in sizes.withColumn("__h", F.xxhash64("__id")).orderBy("__h", "__id").collect():
        if n <= left[y]:
            left[y] -= n
            chosen.append((i, y))
    small = F.broadcast(docs.sparkSession.createDataFrame(chosen, picked.schema))  # 2 * sample rows of an id and a label
    rows = text.join(small, "__id").select("__id", "__t", "__y")
    got = sorted((zlib.crc32(str(i).encode()), str(i), t.encode(), y) for i, t, y in rows.toLocalIterator())
    return [(t, y) for *_, t, y in got]


def scorer(model: dict):
    """A function from texts to the columns of OUT."""

    def score(texts: list[bytes]) -> dict:
        tokens = [tokens_of(t) for t in texts]
        mu, lengths = token_marginals(tokens, model)
        x = document_features(mu, lengths)
        z = x @ model["curve"]
        starts = np.cumsum(lengths) - lengths
        spans: list[list[dict]] = [[] for _ in texts]
        hot = np.flatnonzero(mu >= SPAN_LEAST)
        doc = np.searchsorted(starts, hot, "right") - 1
        for d in np.unique(doc).tolist():
            spans[d] = _offsets(texts[d], (hot[doc == d] - starts[d]).tolist(), mu[starts[d] : starts[d] + lengths[d]])
        sums = np.exp(x[:, 2]) - 0.01
        return {"score": (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist(), "n_tokens": lengths.tolist(), "expected": sums.tolist(), "spans": spans}

    return score


def _offsets(text: bytes, hot: list[int], mu: np.ndarray) -> list[dict]:
    """Code point offsets of runs of hot tokens."""
    tokens, out, at, chars = text.split(), [], 0, 0
    wanted, k = set(hot), 0
    for k in range(hot[-1] + 1):
        start = text.index(tokens[k], at)
        if k in wanted:
            chars += len(text[at:start].decode())
            end = chars + len(tokens[k].decode())
            if out and k - 1 in wanted:
                out[-1]["end"], out[-1]["marginal"] = end, max(out[-1]["marginal"], float(mu[k]))
            else:
                out.append({"start": chars, "end": end, "marginal": float(mu[k])})
            chars, at = end, start + len(tokens[k])
        else:
            chars += len(text[at : start + len(tokens[k])].decode())
            at = start + len(tokens[k])
    return out


def tag(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all but the text, if None), score, n_tokens, expected (toxic tokens) and spans."""
    model_b = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS weights
    return map_texts(docs, text_col, others(docs, text_col) if keep is None else keep, OUT, lambda: scorer(model_b.value))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.pmod(F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    return fit(training_sample(docs.where(~held_out(id_col)), labels.where(~held_out(id_col)), id_col, text_col, label_col))
