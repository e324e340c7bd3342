"""Phrase collocations by counting quotient filters.

Words that occur often enough get numbers. A phrase of k such words is one packed number of k times the bits of a word number; a
permutation that can be undone spreads it, its highest bits say which shard it belongs to, the next ones are its quotient in that
shard's filter, and all the others are kept as its remainder, so that a filter loses nothing. Each chunk of text makes a filter for
each shard; a shard merges its sorted filters, finds the phrases that are frequent in all of them, and tells each chunk by one bit for
each of its phrases which ones. Longer phrases are then counted only where all their parts are frequent, which drops no candidate.
"""

from __future__ import annotations

import itertools
import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import col, mixed, numbered, work_dir, written

#: Phrases have two to LONGEST words and so many occurrences at least.
LONGEST, LEAST = 4, 30
#: Phrases of each language that are returned.
TOP = 2_000
#: A phrase goes if a longer one around it has so many hundredths of its occurrences.
COVERED = 80
#: Tokens after which a chunk of whole texts is full, and tokens of all texts for each shard.
CHUNK, SHARD = 1_000_000, 2_000_000
#: Parts of a language's phrases whose first ones are found apart.
GROUPS = 32
#: Bytes of a text whose tokens are listed at once, up to the next place between pieces.
AT_ONCE = 2_000_000

#: A-Z in lower case, tabs as spaces, and what ends a piece as line ends.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256))
_U = np.uint64


# ---- words of chunks ----


def _pieces(text: bytes):
    """The cleaned text in parts that end where pieces do."""
    text, lo = text.translate(_CLEAN), 0
    while len(text) - lo > AT_ONCE and (hi := text.find(b"\n", lo + AT_ONCE)) >= 0:
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def _chunks(full: int):
    """Of each chunk a row with its codes (local word numbers from 1, 0 between pieces) and a row for each (lang, word) with its count."""

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        names = ["chunk", "codes", "local", "lang", "word", "n"]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.string(), pa.int64()]
        parts, size, counter, ids = [], 0, itertools.count(1), {}

        def batch_of(size: int, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(names, kinds, strict=True)], names)

        def flush():
            chunk, codes = part << 32 | number, np.concatenate(parts)
            counts = np.bincount(codes)
            for lang, of in ids.items():
                words = [(w.decode(), k) for w, k in of.items() if k > 0]
                for lo in range(0, len(words), 100_000):
                    own = words[lo : lo + 100_000]
                    local = [k for _, k in own]
                    yield batch_of(len(own), chunk=[chunk] * len(own), local=local, lang=[lang] * len(own), word=[w for w, _ in own], n=counts[local])
            yield batch_of(1, chunk=[chunk], codes=[pack_codes(codes)])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                of = ids.get(lang)
                if of is None:
                    of = ids[lang] = defaultdict(counter.__next__)
                    of[b"\n"], of[b""] = 0, -1
                for part_text in _pieces(text.as_py() or b""):
                    tokens = part_text.replace(b"\n", b" \n ").split(b" ")
                    codes = np.fromiter(map(of.__getitem__, tokens), np.int32, len(tokens))
                    parts.append(codes[codes >= 0])
                    size += len(parts[-1])
                parts.append(np.zeros(1, np.int32))
                if size >= full:
                    yield from flush()
                    parts, size, counter, ids, number = [], 0, itertools.count(1), {}, number + 1
        if parts:
            yield from flush()

    return run


def pack_codes(codes: np.ndarray) -> bytes:
    return struct.pack("<Q", codes.nbytes) + pa.compress(codes.astype("<u4").tobytes(), "zstd", asbytes=True)


def unpack_codes(body: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(body[8:], struct.unpack_from("<Q", body)[0], "zstd"), "<u4")


# ---- packed phrases and their permutation ----


def widths(k: int, bits: int) -> tuple[int, int]:
    """Bits of the two halves of a packed phrase of k words."""
    return (bits, bits) if k == 2 else (2 * bits, (k - 2) * bits)


def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def permuted(high: np.ndarray, low: np.ndarray, wide: tuple[int, int], back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of all pairs of halves: four rounds, each of which adds (modulo 2) a number made of one half to the other."""
    for step in range(3, -1, -1) if back else range(4):
        if step % 2:
            low = low ^ (mixed(high + _U(0x51ED270B * (step + 1))) & _mask(wide[1]))
        else:
            high = high ^ (mixed(low + _U(0x2545F491 * (step + 1))) & _mask(wide[0]))
    return high, low


def packed(codes: np.ndarray, at: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    w = [codes[at + j].astype(_U) for j in range(k)]
    two = lambda a, b: a << _U(bits) | b
    return {2: lambda: (w[0], w[1]), 3: lambda: (two(w[0], w[1]), w[2]), 4: lambda: (two(w[0], w[1]), two(w[2], w[3]))}[k]()


def unpacked(high: np.ndarray, low: np.ndarray, k: int, bits: int) -> list[np.ndarray]:
    halves = lambda x: [x >> _U(bits), x & _mask(bits)]
    return {2: lambda: [high, low], 3: lambda: [*halves(high), low], 4: lambda: [*halves(high), *halves(low)]}[k]()


def _order(high: np.ndarray, low: np.ndarray, wide: tuple[int, int]) -> np.ndarray:
    """A stable order by both halves; runs that are sorted already are merged."""
    return np.argsort(high << _U(wide[1]) | low, kind="stable") if sum(wide) <= 64 else np.lexsort((low, high))


def tally(codes: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct permuted phrases of k words in order (two halves) and their counts; the places of all phrases, and which one each is."""
    there = codes > 0
    full = there[: max(len(codes) - k + 1, 0)].copy()
    for j in range(1, k):
        full &= there[j : j + len(full)]
    at = np.flatnonzero(full)
    wide = widths(k, bits)
    high, low = permuted(*packed(codes, at, k, bits), wide)
    order = _order(high, low, wide)
    high, low = high[order], low[order]
    first = np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))[: len(high)]
    which = np.empty(len(at), np.int64)
    which[order] = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    return high[begin], low[begin], np.diff(np.append(begin, len(high))), at, which


# ---- filters ----


def _bits_in(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, one after the other."""
    out = [np.packbits(np.unpackbits(values[lo : lo + 80_000].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width :].ravel()) for lo in range(0, len(values), 80_000)]
    return b"".join(x.tobytes() for x in out)  # 80,000 values end at a byte


def _bits_out(body: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros(n, _U)
    for lo in range(0, n if width else 0, 80_000):
        m = min(80_000, n - lo)
        bits = np.unpackbits(body[lo * width // 8 : (lo + m) * width // 8 + 1], count=m * width).reshape(m, width)
        whole = np.zeros((m, 64), np.uint8)
        whole[:, 64 - width :] = bits
        out[lo : lo + m] = np.packbits(whole, axis=1).view(">u8").ravel()
    return out


def filter_of(high: np.ndarray, low: np.ndarray, counts: np.ndarray, wide: tuple[int, int], known: int) -> bytes:
    """The counting quotient filter of sorted distinct phrases whose first `known` bits are the same.

    Run lengths of all quotients in unary, then full remainders, then counters: a bit for each count above 1, a byte for those of them below
    257, eight bytes for others. There are about as many quotients as phrases."""
    n, rest = len(high), wide[0] - known
    q = min(rest, max(n, 1).bit_length() - 1)
    quotient = ((high & _mask(rest)) >> _U(rest - q)).astype(np.int64)
    runs = np.zeros(n + (1 << q), np.uint8)
    runs[np.arange(n) + quotient] = 1
    more = counts > 1
    over = counts[more] - 2
    return b"".join((struct.pack("<IB", n, q), np.packbits(runs).tobytes(), _bits_in(high, rest - q), _bits_in(low, wide[1]), np.packbits(more).tobytes(), np.minimum(over, 255).astype(np.uint8).tobytes(), over[over >= 255].astype("<u8").tobytes()))


def entries_of(body: bytes, wide: tuple[int, int], known: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted phrases and counts that filter_of was given; prefix: their first `known` bits."""
    n, q = struct.unpack_from("<IB", body)
    rest, data, at = wide[0] - known, np.frombuffer(body, np.uint8), 5

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return data[at - size : at]

    runs = np.unpackbits(take((n + (1 << q) + 7) // 8), count=n + (1 << q))
    quotient = (np.flatnonzero(runs) - np.arange(n)).astype(_U)
    size = lambda width: (n // 80_000) * (80_000 * width // 8) + (n % 80_000 * width + 7) // 8
    high = _U(prefix) << _U(rest) | quotient << _U(rest - q) | _bits_out(take(size(rest - q)), n, rest - q) if n else np.zeros(0, _U)
    low = _bits_out(take(size(wide[1])), n, wide[1])
    more = np.unpackbits(take((n + 7) // 8), count=n).astype(bool)
    over = take(int(more.sum())).astype(np.int64)
    big = over == 255
    over[big] = np.frombuffer(body, "<u8", int(big.sum()), at)
    counts = np.ones(n, np.int64)
    counts[more] = over + 2
    return high, low, counts


def merged(filters: list[tuple[np.ndarray, np.ndarray, np.ndarray]], wide: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted phrases and summed counts of several sorted filters, and which of them each entry, in the order given, is."""
    high, low, counts = (np.concatenate(x) for x in zip(*filters, strict=True))
    order = _order(high, low, wide)
    high, low = high[order], low[order]
    first = np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))[: len(high)]
    which = np.empty(len(high), np.int64)
    which[order] = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    return high[begin], low[begin], np.add.reduceat(counts[order], begin) if len(begin) else counts, which


# ---- chunks and shards ----


def _to_shards(k: int, bits: int, known: int):
    """A chunk's filters of phrases of k words, one for each shard that has any."""

    def run(batches):
        wide = widths(k, bits)
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                high, low, counts, _, _ = tally(unpack_codes(body.as_py()), k, bits)
                edges = np.searchsorted(high >> _U(wide[0] - known), np.arange((1 << known) + 1).astype(_U)).tolist()
                own = [(s, filter_of(high[lo:hi], low[lo:hi], counts[lo:hi], wide, known)) for s, (lo, hi) in enumerate(itertools.pairwise(edges)) if lo < hi]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(own), pa.int64()), pa.array([s for s, _ in own], pa.int32()), pa.array([b for _, b in own], pa.binary())], ["chunk", "shard", "body"])

    return run


def _merge_shard(k: int, bits: int, known: int, least: int):
    """A shard's filters merged: rows of its frequent phrases, and for each chunk a bit for each of its phrases, set for frequent ones."""

    def run(key, group):
        wide, shard = widths(k, bits), key[0].as_py()
        filters = [entries_of(b.as_py(), wide, known, shard) for b in group["body"]]
        sizes = [len(f[0]) for f in filters]
        high, low, counts, which = merged(filters, wide)
        frequent = counts >= least
        flags = np.split(frequent[which], np.cumsum(sizes)[:-1])
        words = unpacked(*permuted(high[frequent], low[frequent], wide, back=True), k, bits)
        n, chunks = int(frequent.sum()), len(sizes)
        phrases = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(np.stack(words, 1).ravel().astype(np.int64)))
        return pa.table({
            "chunk": pa.concat_arrays([group["chunk"].combine_chunks(), pa.nulls(n, pa.int64())]),
            "shard": pa.array([shard] * (chunks + n), pa.int32()),
            "body": pa.array([np.packbits(f).tobytes() for f in flags] + [None] * n, pa.binary()),
            "w": pa.concat_arrays([pa.nulls(chunks, phrases.type), phrases]),
            "n": pa.concat_arrays([pa.nulls(chunks, pa.int64()), pa.array(counts[frequent])]),
        })

    return run


def longer_runs(codes: np.ndarray, k: int, frequent: np.ndarray) -> np.ndarray:
    """The runs of two or more overlapping phrases of k words that are all frequent (a flag for each place), set apart by zeros."""
    edge = np.diff(np.concatenate(([0], frequent.astype(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= 2
    begin, size = begin[long], (end - begin)[long] + k  # k - 1 more words and a zero
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    last = np.repeat(size, size) - 1
    out = np.zeros(len(place), codes.dtype)
    inside = place < last
    out[inside] = codes[(np.repeat(begin, size) + place)[inside]]
    return out


def _narrowed(k: int, bits: int, known: int):
    """Chunks left to what phrases of k + 1 words can stand in. Rows come by chunk: bits from its shards in order, then its codes."""

    def run(batches):
        wide, chunk, flags = widths(k, bits), None, {}
        for batch in batches:
            for now, shard, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if now != chunk:
                    chunk, flags = now, {}
                if shard < 1 << known:
                    flags[shard] = np.frombuffer(body.as_py(), np.uint8)
                    continue
                codes = unpack_codes(body.as_py())
                high, _, _, at, which = tally(codes, k, bits)
                sizes = np.bincount((high >> _U(wide[0] - known)).astype(np.int64), minlength=1 << known)
                keep = np.concatenate([np.unpackbits(flags[s], count=n) for s, n in enumerate(sizes.tolist()) if n] + [np.zeros(0, np.uint8)]).astype(bool)
                frequent = np.zeros(len(codes), bool)
                frequent[at] = keep[which]
                left = longer_runs(codes, k, frequent)
                if len(left):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pack_codes(left)], pa.binary())], ["chunk", "codes"])

    return run


def _global_codes(batches):
    """Chunks in global word numbers. Rows come by chunk: (local, id) of its frequent words, then its codes; other words become 0."""
    chunk, local, ids = None, [], []
    for batch in batches:
        chunks, coded = batch.column(0).to_numpy(), batch.column(3).is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate(([True], (chunks[1:] != chunks[:-1]) | coded[1:] | coded[:-1], [True]))) if len(batch) else []
        for lo, hi in itertools.pairwise(edges):
            if chunks[lo] != chunk:
                chunk, local, ids = chunks[lo], [], []
            if not coded[lo]:
                local.append(batch.column(1).slice(lo, hi - lo).to_numpy())
                ids.append(batch.column(2).slice(lo, hi - lo).to_numpy())
                continue
            codes = unpack_codes(batch.column(3)[lo].as_py())
            to = np.zeros(int(codes.max(initial=0)) + 1, np.uint32)
            if local:
                to[np.concatenate(local)] = np.concatenate(ids)
            codes = to[codes]
            there = codes > 0
            # no phrase has a word between two zeros in it, and zeros behind zeros add nothing
            kept = there & (np.append(there[1:], False) | np.append(False, there[:-1]))
            codes = np.where(kept, codes, 0)[kept | np.append(False, kept[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pack_codes(codes)], pa.binary())], ["chunk", "codes"])


def count_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, full: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n) of all words; (id, lang, word, n) of the frequent ones; (w, n), the frequent phrases as arrays of word ids, one word included."""
    top = work_dir(df.sparkSession)
    texts = df.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"), col(text_col).cast("string").alias("text"))
    chunks = written(texts.mapInArrow(_chunks(full), "chunk long, codes binary, local int, lang string, word string, n long"), f"{top}/chunks")
    own = chunks.where("word is not null")
    totals = written(own.groupBy("lang").agg(F.sum("n").alias("n")), f"{top}/totals")
    words = numbered(own.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "id", f"{top}/words")
    shape = words.agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).first()
    bits = max(int(shape.words).bit_length(), 1)
    if bits > 32:
        raise ValueError("word numbers have 32 bits, and there are more frequent words")
    known = min(max((int(shape.tokens or 0) // SHARD).bit_length(), 3), bits)

    def by_chunk(rows: DataFrame, order: str) -> DataFrame:
        return rows.repartition("chunk").sortWithinPartitions("chunk", order)

    named = own.join(words.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "local", "id", F.lit(None).cast("binary").alias("codes"))
    coded = chunks.where("codes is not null").select("chunk", F.lit(2**31 - 1).cast("int").alias("local"), F.lit(None).cast("long").alias("id"), "codes")
    left = written(by_chunk(named.unionByName(coded), "local").mapInArrow(_global_codes, "chunk long, codes binary"), f"{top}/codes-2")
    phrases = words.select(F.array("id").alias("w"), "n")
    for k in range(2, longest + 1):
        filters = left.mapInArrow(_to_shards(k, bits, known), "chunk long, shard int, body binary")
        found = written(filters.groupBy("shard").applyInArrow(_merge_shard(k, bits, known, least), "chunk long, shard int, body binary, w array<long>, n long"), f"{top}/shards-{k}")
        phrases = phrases.unionByName(found.where("chunk is null").select("w", "n"))
        if k < longest:
            marks = found.where("chunk is not null").select("chunk", "shard", "body")
            codes = left.select("chunk", F.lit(1 << known).alias("shard"), F.col("codes").alias("body"))
            left = written(by_chunk(marks.unionByName(codes), "shard").mapInArrow(_narrowed(k, bits, known), "chunk long, codes binary"), f"{top}/codes-{k + 1}")
    return totals, words, phrases


# ---- scores ----


def _big(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """(w, a, l, r, score) of all phrases of two words and more, by their lowest-scoring cut."""
    several = phrases.where(F.size("w") > 1)
    cuts = several.select("w", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("left"), F.slice("w", F.col("k") + 1, F.size("w")).alias("right"))
    both = cuts.join(phrases.select(F.col("w").alias("left"), F.col("n").alias("l")), "left").join(phrases.select(F.col("w").alias("right"), F.col("n").alias("r")), "right")
    both = both.withColumns({"whole": _big("a") * F.lit(2_000_000).cast("decimal(7,0)"), "parts": _big("l") + _big("r")})
    both = both.withColumn("score", F.expr("cast(whole div parts as bigint)"))
    best = both.groupBy("w").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s"))
    return best.select("w", "s.a", "s.l", "s.r", "s.score")


def uncovered(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """The rows (w, a) that stand in no longer phrase of COVERED hundredths of their occurrences or more."""
    n = F.size("w")
    starts = F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda at: F.slice("w", at, m)))
    inner = phrases.where(n > 2).select(F.explode(F.flatten(starts)).alias("w"), "n").groupBy("w").agg(F.max("n").alias("most"))
    hundreds = F.col("most").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)") >= _big("a") * F.lit(COVERED).cast("decimal(3,0)")
    return rows.join(inner, "w", "left").where(~F.coalesce(hundreds, F.lit(False))).drop("most")


def mine(df: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, least: int = LEAST, full: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, occurrences and text.

    A null language is `und`, together with rows of that name. Null, empty and blank texts have no words; texts of any length count
    whole, repeated rows count again, other columns are not read. Equal scores go by occurrences, then by the phrase's bytes. A language
    without a frequent phrase, and an empty table, give no rows."""
    totals, words, phrases = count_phrases(df, text_col, lang_col, least, full=full)
    kept = uncovered(scored(phrases), phrases)
    lang = words.select(F.col("id").alias("first"), "lang")
    placed = kept.withColumn("first", F.get("w", F.lit(0))).join(lang, "first").drop("first")
    # the phrases' texts are put together only for those that may be among the first: the first of each of GROUPS, so that no more than
    # these meet in one place for a language, then the first of all
    best = lambda *group: F.rank().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("a")))
    some = placed.withColumn("group", F.pmod(F.xxhash64("w"), F.lit(GROUPS))).withColumn("place", best("lang", "group")).where(F.col("place") <= top)
    likely = some.withColumn("place", best("lang")).where(F.col("place") <= top).drop("place", "group")
    letters = likely.select("w", F.posexplode("w").alias("pos", "id")).join(words.select("id", "word"), "id").groupBy("w").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("s"))  # of four at most
    named = likely.join(letters.select("w", F.array_join("s.word", " ").alias("phrase")), "w").join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
