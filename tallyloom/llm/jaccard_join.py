"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of hashed runs of SHINGLE words (a text of fewer words, but not none, is one run). Texts of equal sets form a
class and are handled once. Classes that share a band of MinHash values may be similar; what bands connect forms a group, and
a group's classes are compared in blocks of BLOCK or so (fewer long ones). Within a task, pairs are compared STEP MinHash values at a time,
and dropped when the posterior probability of reaching the threshold, under a uniform prior, is below TOLERANCE; what is left
is verified exactly on the sets. Tasks return counts and local roots for each class, never pairs, so a group of n near
copies makes rows in proportion to n (n * n / BLOCK at most), not to its pairs.

A pair of exactly the threshold is missed with probability (1 - 0.8 ** 6) ** 42 = 3e-6 by the bands and less than TOLERANCE
at each step by pruning. Runs are identified by 64-bit hashes of their words' hashes (token_hashes), sets by 128 bits of BLAKE2b.
Null and empty texts and rows without id are in no class but their own and have no links. Repeated rows are copies of each
other; rows of one id but different texts are in the classes of their texts. Ids may be of any type that can be ordered. Columns
of the input other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import col, map_texts, mixed, remove, runtime_filters, token_hashes, work_dir, written
from tallyloom.llm.components import connected_components

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 6, 42
STEP, TOLERANCE = 42, 1e-6
BLOCK = 128
#: Bytes of the sets in one block, on average.
BLOCK_BYTES = 4_000_000
#: Bytes of text in one call, so that its arrays stay small.
CALL_BYTES = 1_500_000

_MULTIPLY = mixed(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)

PRINT = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("bands", T.BinaryType()), T.StructField("size", T.LongType())])
SETS = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType()), T.StructField("shingles", T.BinaryType())])


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of hashed runs of n words of each text."""
    words, counts = token_hashes(texts)
    factors = mixed(np.arange(11, 11 + n, dtype=np.uint64)) | np.uint64(1)
    ends = np.cumsum(counts)
    runs = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        runs += words[k : k + len(runs)] * factors[k]
    runs = mixed(runs)
    out = []
    for size, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if size >= n:
            out.append(np.unique(runs[end - size : end - n + 1]))
        elif size:
            out.append(mixed((words[end - size : end] * factors[:size]).sum(keepdims=True) + np.uint64(size)))
        else:
            out.append(runs[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for each set; rows of empty sets are zero."""
    out = np.zeros((len(sets), ROWS * BANDS), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([(sets[i] >> np.uint64(32)).astype(np.uint32) for i in full])
        starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for k, a in enumerate(_MULTIPLY):
            out[full, k] = np.minimum.reduceat(flat * a, starts)
    return out


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _prints(texts: list[bytes]) -> dict:
    sets = shingle_sets(texts)
    rows = signatures(sets).astype(np.uint64).reshape(len(texts), BANDS, ROWS)
    keys = np.full((len(texts), BANDS), 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return {"digest": [_digest(s) for s in sets], "bands": [k.tobytes() if len(s) else None for k, s in zip(keys, sets, strict=True)], "size": [len(s) for s in sets]}


def _sets(texts: list[bytes]) -> dict:
    sets = shingle_sets(texts)
    return {"digest": [_digest(s) for s in sets], "signature": [r.tobytes() for r in signatures(sets)], "shingles": [s.tobytes() for s in sets]}


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n compared values, the least number of equal ones with which the posterior chance of reaching the threshold is `tolerance`.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1), whose upper tail at t is P(Bin(n + 1, t) <= m)."""
    out = np.zeros(ROWS * BANDS + 1, np.int64)
    for n in range(1, len(out)):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def similar_pairs(a_sig, a_sets, b_sig, b_sets, same: bool, threshold: float = THRESHOLD, least=None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) whose sets reach the threshold; i < j where a and b are the same."""
    least = least_matches(threshold) if least is None else least
    na, nb = np.array([len(s) for s in a_sets]), np.array([len(s) for s in b_sets])
    fits = np.minimum(na[:, None], nb[None]) >= threshold * np.maximum(na[:, None], nb[None]) - 1e-9
    i, j = np.nonzero(np.triu(fits, 1) if same else fits)
    equal = np.zeros(len(i), np.int64)
    for lo in range(0, ROWS * BANDS, STEP):
        hi = min(lo + STEP, ROWS * BANDS)
        for k in range(lo, hi):
            equal += a_sig[i, k] == b_sig[j, k]
        keep = equal >= least[hi]
        i, j, equal = i[keep], j[keep], equal[keep]
    if not len(i):
        return i, j
    ai, aj = np.unique(i, return_inverse=True)
    bi, bj = np.unique(j, return_inverse=True)
    both = [a_sets[k] for k in ai] + [b_sets[k] for k in bi]
    shared, place = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    common = np.zeros((len(ai), len(bi)), np.float32)
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    width = 1 << 14
    for lo in range(0, len(shared), width):
        a, b = np.searchsorted(place, (lo, lo + width))
        m = np.zeros((len(both), min(width, len(shared) - lo)), np.float32)
        m[row[a:b], place[a:b] - lo] = 1
        common += m[: len(ai)] @ m[len(ai) :].T
    c = common[aj, bj].astype(np.int64)
    yes = c >= threshold * (na[i] + nb[j] - c) - 1e-9
    return i[yes], j[yes]


COMPARED = T.StructType([T.StructField("node", T.LongType()), T.StructField("n_texts", T.LongType()), T.StructField("n_rows", T.LongType()), T.StructField("root", T.LongType())])


def _compared(threshold: float):
    """Over rows sorted by (gid, x, y): what each block pair finds, a row for each class of it with links."""
    names = ["gid", "x", "y", "side", "node", "n", "signature", "shingles"]

    def run(batches):
        least = least_matches(threshold)

        def judged(rows):
            rows = list({r[3:5]: r for r in rows}.values())  # a class comes twice if rows of its id and text repeat
            sig = np.stack([np.frombuffer(r[6], np.uint32) for r in rows])
            sets = [np.frombuffer(r[7], np.uint64) for r in rows]
            node, n = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
            side = np.array([r[3] for r in rows])
            if (side == 0).all():
                a = b = np.arange(len(rows))
                i, j = similar_pairs(sig, sets, sig, sets, True, threshold, least)
            else:
                a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                i, j = similar_pairs(sig[a], [sets[k] for k in a], sig[b], [sets[k] for k in b], False, threshold, least)
            i, j = a[i], b[j]
            texts = np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
            docs = np.bincount(i, n[j], len(rows)) + np.bincount(j, n[i], len(rows))
            root = node.copy()
            while True:
                low = np.minimum(root[i], root[j])
                new = root.copy()
                np.minimum.at(new, i, low)
                np.minimum.at(new, j, low)
                if (new == root).all():
                    break
                root = new
            hit = np.flatnonzero(texts)
            return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(texts[hit]), pa.array(docs[hit].astype(np.int64)), pa.array(root[hit])], COMPARED.names)

        key, rows = None, []
        # a thousand rows at a time are taken out of a batch, whose sets are long
        for part in (batch.slice(lo, 1000) for batch in batches for lo in range(0, batch.num_rows, 1000)):
            for r in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                if r[:3] != key:
                    if len(rows) > 1:
                        yield judged(rows)
                    key, rows = r[:3], []
                rows.append(r)
        if len(rows) > 1:
            yield judged(rows)

    return run


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK, extra: dict | None = None) -> DataFrame:
    """A row for each row of docs: id, the columns `extra`, rep (the smallest id with the same set), n (rows with that set), root (a number
    for all that links connect; null without id or words), class_id (the smallest id there), n_texts and n_rows (classes and rows linked)."""
    spark = docs.sparkSession
    top = work_dir(spark)
    extra = extra or {}
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"), *[c.alias(n) for n, c in extra.items()])
    prints = written(map_texts(rows, "text", ["id", *extra], PRINT, lambda: _prints, CALL_BYTES), f"{top}/prints")
    classes = prints.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    # the number of a class is written with it, and so stays what it is
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), f"{top}/classes")

    # groups: classes that bands connect, by way of the smallest class of each band value
    keyed = classes.select("node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("i"), "bands").select("node", F.substring("bands", F.col("i") * 8 + 1, F.lit(8)).alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("c")).where("c > 1").select("key", "first")
    edges = keyed.join(firsts, "key").select(F.col("node").alias("a"), F.col("first").alias("b"))
    groups = connected_components(edges).join(classes.select("node", "rep", "n", "digest", "size"), "node")
    groups = written(groups, f"{top}/groups")
    sizes = groups.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / F.lit(block), 8 * F.sum("size") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    members = written(groups.join(sizes, "root").select("node", F.col("root").alias("gid"), "blocks", "rep", "n", F.col("digest").alias("want")), f"{top}/members")

    # each class goes to the block pairs of its group that it has a part in
    # (the filter, which all pass, is what lets Spark put a Bloom filter of the members on the texts; the hint deals texts alike at any size)
    texts = rows.select("id", "text").join(members.where("blocks > 0").hint("merge"), F.col("id") == F.col("rep"))
    full = map_texts(texts, "text", ["node", "gid", "blocks", "n", "want"], SETS, lambda: _sets, CALL_BYTES).where("digest = want")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("gid", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "n", "signature", "shingles")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    pairs = dealt.repartition(parts, "gid", "x", "y").sortWithinPartitions("gid", "x", "y")
    with runtime_filters(spark):  # most texts are in no group
        found = written(pairs.mapInArrow(_compared(threshold), COMPARED), f"{top}/found")
    remove(spark, top, "members", "groups")

    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_rows").alias("n_rows"))
    known = classes.select("digest", "rep", "n", "node").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.where("n_texts > 0").groupBy("root").agg(F.min("rep").alias("class_id"))
    known = written(known.join(least, "root", "left").select(F.col("digest").alias("d"), "rep", "n", "root", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")), f"{top}/known")
    remove(spark, top, "classes", "found")
    own_digest = F.when(F.col("id").isNotNull(), F.col("digest"))
    return prints.select("id", *extra, own_digest.alias("digest")).join(known, F.col("digest") == F.col("d"), "left").drop("digest", "d")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: id, copy_id (the smallest id with the same set), class_id (the smallest id that links lead to),
    n_links (other rows whose similarity reaches the threshold) and n_texts (other classes of them)."""
    n_links = F.coalesce(F.col("n_rows") + F.col("n") - 1, F.lit(0)).cast("long")
    found = classified(docs, id_col, text_col, threshold, block)
    return found.select(F.col("id").alias(id_col), F.coalesce("rep", "id").alias("copy_id"), F.coalesce("class_id", "id").alias("class_id"), n_links.alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without those that have a similar one with a smaller id (the smaller text hash, if the ids are equal); of rows that
    repeat id and text one stays. Rows without id stay. All columns stay, whatever their names."""
    sha = F.coalesce(F.sha2(col(text_col).cast("string"), 256), F.lit(""))
    found = classified(docs, id_col, text_col, threshold, extra={"sha": sha}).where("id is not null")
    pairs = written(found.groupBy("id", "sha").agg(F.first("root").alias("root"), F.count("*").alias("times")))
    best = pairs.where("root is not null").groupBy("root").agg(F.min(F.struct("id", "sha")).alias("b")).select("b.id", "b.sha", F.lit(True).alias("best"))
    judged = pairs.join(best, ["id", "sha"], "left").select("id", "sha", "times", (F.col("root").isNull() | F.coalesce("best", F.lit(False))).alias("stays"))
    judged = written(judged.where("not stays or times > 1").select(F.col("id").alias("__id"), F.col("sha").alias("__sha"), "stays").withColumnRenamed("stays", "__stays"))
    # the texts are dealt by id and hash once, at any size, and rows that repeat both meet there too
    rows = docs.withColumns({"__own": col(id_col), "__hash": sha})
    both = rows.join(judged.hint("merge"), (F.col("__own") == F.col("__id")) & (F.col("__hash") == F.col("__sha")), "left")
    both = both.withColumn("__n", F.row_number().over(Window.partitionBy("__own", "__hash").orderBy(F.lit(1))))
    kept = both.where(F.col("__own").isNull() | (F.coalesce("__stays", F.lit(True)) & (F.col("__n") == 1)))
    return kept.select(*[col(c) for c in docs.columns])
