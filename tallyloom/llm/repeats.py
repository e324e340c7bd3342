"""Suffix-array deduplication: removes each byte that a string of LENGTH bytes covers which also starts elsewhere.

Every window of LENGTH bytes holds LENGTH - GRAM + 1 runs of GRAM bytes; its anchor is the one with the least hash (the first
of equals). Equal windows have equal anchors at equal offsets, so only windows at equal anchors need to be compared. The
windows with one anchor are neighbours and make a block. Blocks are compared in two steps:

1. anchors that stand at one place only have no repeats; if all blocks at an anchor are equal bytes, all of them repeat;
2. the distinct blocks at each other anchor go to one task, which sorts the suffixes that start at the anchors, and what stands
   before the anchors read backwards. Each sort is a mergesort whose comparisons find the common extension of two suffixes by
   binary search over prefix polynomial hashes; common extensions of neighbours are then compared byte for byte, and groups for
   which hashes said too much are sorted on their bytes. Two blocks share a window that starts o bytes before the anchor if they
   agree on o bytes backwards and LENGTH - o forwards, which the two orders tell for all blocks at once.

An anchor with more than MOST distinct blocks isn't brought to one task, so that a passage which very many texts have can't
overload it: there, digests of what runs of RUN windows share are counted across tasks, then those of single windows where that
leaves it open. Blocks, runs and texts are identified by 128 bits (texts 120) of BLAKE2b or SHA-256 of their bytes.

Texts are compared as UTF-8 bytes, matches never cross texts. Equal texts are handled once: if they have LENGTH bytes, all of
them repeat. Null and empty texts have no bytes. Rows with a null id are treated as any other. Repeated rows are repeats of each
other. Columns of the input other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import col, powers, prefix_hashes, remove, runtime_filters, slices, span_hashes, work_dir, written

LENGTH, GRAM = 200, 32
#: Distinct blocks of an anchor that one task sorts, at most; more are counted across tasks.
MOST = 10_000
#: Windows that are hashed as one at first, at anchors with more blocks.
RUN = 8
CALL_BYTES = 1_000_000
#: Blocks in one sort, unless one anchor has more.
CALL_BLOCKS = 8_000

_BLOCK = [T.StructField("anchor", T.LongType()), T.StructField("b1", T.LongType()), T.StructField("b2", T.LongType())]  # hash of the anchor's bytes, digest of the block's
ANCHORS = T.StructType(
    [
        T.StructField("k1", T.LongType()),
        T.StructField("k2", T.LongType()),
        *_BLOCK,
        T.StructField("start", T.IntegerType()),  # of the block in its text
        T.StructField("windows", T.ShortType()),
        T.StructField("offset", T.ShortType()),  # of the anchor in the block
    ]
)


def digests(parts) -> np.ndarray:
    """128 bits of each part's bytes, as rows of two numbers."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in parts), "<i8").reshape(-1, 2)


def anchors_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(text number, start, windows, offset, anchor hash, block digest) of all blocks, as arrays."""
    body = b"".join(texts)
    data = np.frombuffer(body, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    span = length - gram + 1
    n = len(data) - length + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros((0, 2), np.int64),)
    if n <= 0:
        return none
    prefix = prefix_hashes(data)
    m = len(data) - gram + 1
    at = np.arange(m)
    grams = span_hashes(prefix, at, at + gram)
    # least of each run of `span`: the hash's high half, then the place
    packed = np.full(-(-m // span) * span, np.uint64(2**64 - 1))
    packed[:m] = (grams >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    del at
    rows = packed.reshape(-1, span)
    head = np.minimum.accumulate(rows, 1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    chosen = (np.minimum(tail[:n], head[span - 1 : span - 1 + n]) & np.uint64((1 << 32) - 1)).astype(np.int64)
    del packed, rows, head, tail
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.flatnonzero(np.arange(n) + length <= np.repeat(np.cumsum(sizes), sizes)[:n])
    if not len(place):
        return none
    new = np.concatenate(([True], (chosen[place[1:]] != chosen[place[:-1]]) | (text[place[1:]] != text[place[:-1]])))
    first = place[new]
    windows = np.diff(np.concatenate((np.flatnonzero(new), [len(place)])))
    chosen, text = chosen[first], text[first]
    block = digests(body[a:b] for a, b in zip(first.tolist(), (first + windows + length - 1).tolist(), strict=True))
    return text, first - (np.cumsum(sizes) - sizes)[text], windows, chosen - first, grams[chosen].view(np.int64), block


def _anchors(length: int):
    def run(batches):
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # long texts are cut into parts that share length - 1 bytes, so that each window is in one of them
            parts = [(i, lo, t[lo : lo + CALL_BYTES + length - 1]) for i, t in enumerate(batch.column(2).cast(pa.binary()).to_pylist()) for lo in range(0, max(1, len(t) - length + 1), CALL_BYTES)]
            for lo, hi in slices([len(p[2]) for p in parts], CALL_BYTES + length):
                row, base = (np.array([p[k] for p in parts[lo:hi]], np.int64) for k in (0, 1))
                text, start, windows, offset, anchor, block = anchors_of([p[2] for p in parts[lo:hi]], length)
                columns = [k1[row[text]], k2[row[text]], anchor, block[:, 0], block[:, 1], (start + base[text]).astype(np.int32), windows.astype(np.int16), offset.astype(np.int16)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ANCHORS.names)
        pa.default_memory_pool().release_unused()

    return run


# ---- suffix sort ----


class Suffixes:
    """Suffixes of `data` that start at `at` and have `extent` bytes, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, extent: np.ndarray) -> None:
        self.data, self.at, self.extent = data, at, extent
        self.prefix = prefix_hashes(data)
        self.inverse = powers(len(self.prefix))[1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions of suffixes i and j, by binary search."""
        a, b = self.at[i], self.at[j]
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.extent[i], self.extent[j])
        pa_, pb, ia, ib = self.prefix[a], self.prefix[b], self.inverse[a], self.inverse[b]
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.prefix[a + mid] - pa_) * ia == (self.prefix[b + mid] - pb) * ib
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        return lo

    def below(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before suffix j, or where or_equal is true, not after it. A suffix comes after its beginnings."""
        n, x, y = self.common(i, j), self.extent[i], self.extent[j]
        ended = n == np.minimum(x, y)
        last = len(self.data) - 1
        return np.where(ended, (x < y) | ((x == y) & or_equal), self.data[np.minimum(self.at[i] + n, last)] < self.data[np.minimum(self.at[j] + n, last)])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """A stable order of the suffixes by group, then content: a mergesort of all groups at once. Groups are given in order."""
        order = np.arange(len(self.at))
        first = np.searchsorted(group, group)
        size = np.searchsorted(group, group, "right") - first
        rank = order - first
        width, most = 1, int(size.max(initial=0))
        while width < most:
            # each item finds its place in the run beside its own
            run = rank // width
            other = first + (run ^ 1) * width
            count = np.clip(first + size - other, 0, width)
            left = (run & 1) == 0  # of equals, the left run's come first
            lo, hi = np.zeros(len(order), np.int64), count.copy()
            while True:
                k = np.flatnonzero(lo < hi)
                if not len(k):
                    break
                mid = (lo[k] + hi[k]) >> 1
                before = self.below(order[other[k] + mid], order[k], ~left[k])
                lo[k[before]], hi[k[~before]] = mid[before] + 1, mid[~before]
            to = first + (run >> 1) * 2 * width + rank % width + lo
            new = order.copy()  # unequal bytes with equal hashes may give two items one place; see ordered()
            new[to] = order
            order = new
            width *= 2
        return order

    def ordered(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, and the common extension of each suffix in it with the one before, -1 for the first of a group; verified on the bytes."""
        order = self.sort(group)
        shared = np.full(len(order), -1, np.int64)
        k = np.flatnonzero(group[1:] == group[:-1]) + 1
        shared[k] = self.common(order[k - 1], order[k])
        body = self.data.tobytes()
        wrong = set(group[np.bincount(order, minlength=len(order)) != 1].tolist())
        i, j = order[k - 1], order[k]
        for g, a, b, x, y, n in zip(*(v.tolist() for v in (group[k], self.at[i], self.at[j], self.extent[i], self.extent[j], shared[k])), strict=True):
            if body[a : a + n] != body[b : b + n] or not (n == x <= y or (n < x and n < y and body[a + n] < body[b + n])):
                wrong.add(g)
        for g in wrong:  # hashes of unequal bytes agreed
            here = np.flatnonzero(group == g)
            text = {i: body[self.at[i] : self.at[i] + self.extent[i]] for i in here.tolist()}
            order[here] = sorted(text, key=text.__getitem__)
            for p, q in zip(here[:-1].tolist(), here[1:].tolist(), strict=True):
                x, y = text[order[p]], text[order[q]]
                shared[q] = next((n for n, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
        return order, shared


def _around(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each suffix the longest common extension with another of its group."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(shared, np.append(shared[1:], -1))
    return out


def repeated_windows(anchor: np.ndarray, windows: np.ndarray, offset: np.ndarray, bodies: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks with different bytes, given in the order of their anchors: (block, first, last) of each run of windows that stand in another block too."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(b) for b in bodies], np.int64)
    windows, offset = windows.astype(np.int64), offset.astype(np.int64)
    group = np.concatenate(([0], np.cumsum(anchor[1:] != anchor[:-1])))
    at = np.cumsum(size) - size + offset
    right = Suffixes(data, at, np.minimum(size - offset, length)).ordered(group)
    left = Suffixes(np.ascontiguousarray(data[::-1]), len(data) - at, offset).ordered(group)
    ahead, behind = np.minimum(_around(*right), size - offset), np.minimum(_around(*left), offset)
    span = int(offset.max(initial=0)) + 1
    hit = np.zeros((len(bodies), span + 1), bool)
    own = np.empty((2, len(bodies)), np.int64)
    for o in range(span):  # windows that start o bytes before the anchor
        k = np.flatnonzero((ahead >= length - o) & (behind >= o))
        if len(k) < 2:
            continue
        for n, ((order, shared), depth) in enumerate(((right, length - o), (left, o))):
            own[n, order] = np.cumsum(shared < depth)
        key = own[0, k] * (len(bodies) + 1) + own[1, k]
        line = np.argsort(key, kind="stable")
        twin = key[line[1:]] == key[line[:-1]]
        hit[k[line[np.concatenate(([False], twin)) | np.concatenate((twin, [False]))]], o] = True
    edge = np.diff(hit.astype(np.int8), axis=1, prepend=0)
    block, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return block, offset[block] - high + 1, offset[block] - low


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
COVERED = T.StructType([*_BLOCK, T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])))])


def _sorted_blocks(length: int):
    """Over rows sorted by anchor: the repeated windows of each block that has some."""

    def judged(rows: pa.Table) -> pa.RecordBatch:
        anchor, b1, b2, windows, offset = (rows.column(k).to_numpy() for k in range(5))
        block, first, last = repeated_windows(anchor, windows, offset, rows.column(5).to_pylist(), length)
        one, n = np.unique(block, return_counts=True)
        spans = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["a", "b"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), spans).cast(_SPANS)
        return pa.RecordBatch.from_arrays([pa.array(anchor[one]), pa.array(b1[one]), pa.array(b2[one]), lists], COVERED.names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, CALL_BLOCKS):
                part = batch.slice(lo, CALL_BLOCKS)
                held.append(part)
                n += part.num_rows
                if n < CALL_BLOCKS:
                    continue
                rows = pa.Table.from_batches(held)
                anchor = rows.column(0).to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))  # blocks of the last anchor may be still to come
                if cut:
                    yield judged(rows.slice(0, cut))
                held, n = rows.slice(cut).to_batches(), rows.num_rows - cut
        if n:
            yield judged(pa.Table.from_batches(held))
        pa.default_memory_pool().release_unused()

    return run


HASHED = T.StructType([*_BLOCK, *[T.StructField(n, T.IntegerType()) for n in ("a", "b")], *[T.StructField(n, T.LongType()) for n in ("h1", "h2", "w1", "w2")]])


def _hashed(length: int, run_of: int):
    """Over (*BLOCKS[, runs]): for each run of `run_of` windows of a block (only those in `runs`, if given), its first and last window, a
    digest of the bytes that all of them share and their offset from the anchor, and one of all its bytes."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                out: list[list[np.ndarray]] = [[] for _ in HASHED]
                for anchor, b1, b2, windows, offset, body, *only in zip(*(c.to_pylist() for c in batch.slice(lo, 2000).columns), strict=True):
                    # runs lie on a grid of the anchor's offset, so that equal windows of two blocks are in runs of one kind
                    t = np.concatenate([np.arange(o["a"], o["b"] + 1) for o in only[0]]) if only else np.arange(windows)
                    grid = np.unique((offset - t) // run_of) * run_of
                    a, b = np.maximum(offset - grid - run_of + 1, 0), np.minimum(offset - grid, windows - 1)
                    what_all_share = digests(b"%d %d " % (anchor, g) + body[offset - g : offset - g - run_of + 1 + length] for g in grid.tolist())
                    whole = digests(body[x : y + length] for x, y in zip(a.tolist(), b.tolist(), strict=True))
                    for o, v in zip(out, (*(np.full(len(a), x) for x in (anchor, b1, b2)), a.astype(np.int32), b.astype(np.int32), *what_all_share.T, *whole.T), strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), pa.int32() if f.name in "ab" else pa.int64()) for o, f in zip(out, HASHED, strict=True)], HASHED.names)

    return run


def _shared(hashed: DataFrame, path: str) -> DataFrame:
    """The rows of _hashed() whose shared bytes stand in another block too, with same: whether all bytes of the runs are equal there."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("b1", "b2", "w1", "w2") for n, f in enumerate((F.min, F.max))]
    twice = hashed.groupBy("h1", "h2").agg(*ends).where("b1_0 != b1_1 or b2_0 != b2_1").selectExpr("h1", "h2", "w1_0 = w1_1 and w2_0 = w2_1 as same")
    return hashed.join(written(twice, path), ["h1", "h2"]).select("anchor", "b1", "b2", F.struct("a", "b").alias("s"), "same")


BLOCKS = T.StructType([*_BLOCK, ANCHORS["windows"], ANCHORS["offset"], T.StructField("body", T.BinaryType())])


def _cut(length: int):
    """The bytes of the wanted blocks of each text."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(0)[row].as_py().encode()
                wanted = batch.column(1)[row].values
                w = {wanted.type.field(k).name: wanted.field(k) for k in range(wanted.type.num_fields)}
                bodies = [text[a : a + n + length - 1] for a, n in zip(w["start"].to_pylist(), w["windows"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(w[c] for c in BLOCKS.names[:5]), pa.array(bodies, pa.binary())], BLOCKS.names)

    return run


KEPT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])


def kept_of(text: bytes, ranges: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs, and the rest."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    edges = [0, *[e for s in spans for e in s], len(text)]
    return spans, b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def _keep(with_bytes: bool):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            hashes = []
            for text, whole, ranges in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text or b""
                spans, rest = kept_of(text, [(0, len(text))] if whole else [(r["start"], r["end"]) for r in ranges or ()])
                out[0].append(len(text))
                out[1].append(len(text) - len(rest))
                out[2].append([{"start": a, "end": b} for a, b in spans])
                out[3].append(rest if with_bytes else None)
                hashes.append(hashlib.sha256(rest).hexdigest())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], span), pa.array(out[3], pa.binary()), pa.array(hashes, pa.string())], ["id", *KEPT.names, "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_bytes: bool = True, most: int = MOST) -> DataFrame:
    """For each row of docs: id, n_bytes, n_removed, spans (maximal removed runs), kept (the remaining bytes; null unless with_bytes) and kept_sha256."""
    spark = docs.sparkSession
    top = work_dir(spark)
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"), F.sha2(col(text_col).cast("string"), 256).alias("sha"))
    part = lambda first: F.conv(F.substring("sha", first, 15), 16, 10).cast("long")
    rows = rows.select("id", "text", part(1).alias("k1"), part(16).alias("k2"))
    long_ = rows.where(F.octet_length("text") >= length)
    copies = written(long_.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2"), f"{top}/copies")
    anchors = written(long_.select("k1", "k2", "text").mapInArrow(_anchors(length), ANCHORS), f"{top}/anchors")
    place = F.xxhash64("k1", "k2", "start")
    block = ["anchor", "b1", "b2"]

    # 1. anchors at two places or more, and whether their blocks are all equal
    state = anchors.select(*block, place.alias("p")).groupBy("anchor").agg(*[f(c).alias(f"{c}_{n}") for c in ("p", "b1", "b2") for n, f in enumerate((F.min, F.max))])
    state = written(state.where("p_0 != p_1").selectExpr("anchor", "b1_0 = b1_1 and b2_0 = b2_1 as same"), f"{top}/state")
    found = written(anchors.join(state, "anchor"), f"{top}/found")
    found2 = spark.read.schema(found.schema).parquet(f"{top}/found")
    remove(spark, top, "anchors", "state")

    # 2. one of each distinct block at the other anchors; blocks at two places repeat whole
    first = [F.first(c).alias(c) for c in ("k1", "k2", "start", "windows", "offset")]
    distinct = written(found.where("not same").groupBy(*block).agg(*first, F.min(place).alias("p0"), F.max(place).alias("p1")), f"{top}/distinct")
    crowd = written(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most).select("anchor"), f"{top}/crowd")
    wanted = distinct.groupBy("k1", "k2").agg(F.collect_list(F.struct(*block, "start", "windows", "offset")).alias("wanted"))
    # copies of a text hold the same blocks: one of them is cut
    single = wanted.join(rows.select("k1", "k2", "text"), ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    with runtime_filters(spark):
        blocks = written(single.select("text", "wanted").mapInArrow(_cut(length), BLOCKS), f"{top}/blocks")
    few = blocks.join(crowd, "anchor", "left_anti").select(*BLOCKS.names)
    many = written(blocks.join(crowd, "anchor").select(*BLOCKS.names), f"{top}/many")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_ = few.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_blocks(length), COVERED)
    # runs of RUN windows first: if what they share stands in one block only, none of them repeats; if their bytes agree, all do
    runs = written(_shared(written(many.mapInArrow(_hashed(length, RUN), HASHED), f"{top}/hashed"), f"{top}/twice"), f"{top}/runs")
    open_ = runs.where("not same").groupBy(*block).agg(F.collect_list("s").alias("runs"))
    windows = written(many.join(open_, block).select(*BLOCKS.names, "runs").mapInArrow(_hashed(length, 1), HASHED), f"{top}/windows")
    found_ = runs.where("same").select(*block, "s").unionByName(_shared(windows, f"{top}/twice1").select(*block, "s"))
    counted = found_.groupBy(*block).agg(F.collect_list("s").alias("spans"))
    covered = written(sorted_.unionByName(counted), f"{top}/covered")

    # what is removed of each text that has no copies
    every = F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") - 1).cast("int").alias("b")))
    wholes = distinct.where("p0 != p1").select(*block)
    same = found2.where("same").select("k1", "k2", "start", every.alias("spans"))
    mixed_ = found2.where("not same").select("k1", "k2", *block, "start", "windows")
    # each join is a job of its own, in which Spark splits a block that very many texts have
    whole = written(mixed_.join(wholes, block).select("k1", "k2", "start", every.alias("spans")), f"{top}/whole")
    rest = written(covered.join(wholes, block, "left_anti"), f"{top}/rest")
    part = written(mixed_.join(rest, block).select("k1", "k2", "start", "spans"), f"{top}/part")
    each = same.unionByName(whole).unionByName(part).withColumn("s", F.explode("spans"))
    ranges = each.select("k1", "k2", F.struct((F.col("start") + F.col("s.a")).cast("long").alias("start"), (F.col("start") + F.col("s.b") + length).cast("long").alias("end")).alias("r"))
    removed = ranges.groupBy("k1", "k2").agg(F.collect_set("r").alias("ranges"))
    removed = removed.join(copies, ["k1", "k2"], "left_anti").withColumn("whole", F.lit(False))
    removed = removed.unionByName(copies.select("k1", "k2", F.lit(None).cast(removed.schema["ranges"].dataType).alias("ranges"), F.lit(True).alias("whole")))
    removed = written(removed, f"{top}/removed")
    remove(spark, top, "copies", "found", "distinct", "crowd", "blocks", "many", "hashed", "twice", "runs", "windows", "twice1", "covered", "whole", "rest", "part")
    final = rows.join(removed, ["k1", "k2"], "left").select("id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "ranges")
    out = T.StructType([final.schema["id"], *KEPT, T.StructField("kept_sha256", T.StringType())])
    return final.mapInArrow(_keep(with_bytes), out).withColumnRenamed("id", id_col)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select(*[col(c) for c in kept.columns if c not in (*KEPT.names, "kept_sha256")], "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
