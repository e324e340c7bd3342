"""Spelling variants: words one edit apart, found by pivotal bigrams, and the form that each word goes back to.

Every word keeps its three rarest bigrams (by the number of words that have them). Two disjoint ones of these, the cheapest pair by
dynamic programming, are its pivots. One edit spoils at most one of two disjoint pivots; the other stands in the other word too, as
far from the start (edit behind it) or from the end (edit before it). It is among the other word's first bigrams, up to the rank of
its third: one edit adds two bigrams at most, so the first five occurrences in order of (rank, position) always hold it. What lies
on the pivot's clean side, and the first or second half of what lies on the edited side, is equal as well, so that all of it goes
into the join key, and words that share a frequent beginning do not meet. Words that meet are compared by the parities of their
letter and bigram counts, of which one edit turns two and four at most, and pairs are verified on the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import LOWER_BYTES, col, mixed, numbered, prefix_hashes, remove, slices, span_hashes, work_dir, written

#: Words have so many code points and occurrences at least.
SHORTEST, LEAST = 5, 3
#: Runs whose checksum this divides lose a code point.
SLIPS = 97
#: Distinct words that a task holds before it passes their counts on.
HELD = 500_000
RUN = re.compile("[a-zÀ-ÿ]+")
#: a to z and U+00C0 to U+00FF, so that there are 8,100 bigrams at most.
ALPHABET = 26 + 64
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def slipped(run: str, start: int) -> str:
    """The run without one code point, if its checksum, carried on from `start`, is a multiple of SLIPS."""
    h = zlib.crc32(run.encode(), start)
    return run if h % SLIPS else run[: h % len(run)] + run[h % len(run) + 1 :]


def _count(batches):
    held: Counter = Counter()

    def out():
        words = list(held)
        got = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])
        held.clear()
        return got

    for batch in batches:
        sizes = [len(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for lo, hi in slices(sizes):
            for key, text in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).cast(pa.binary()).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for run, n in Counter(RUN.findall((text or b"").translate(LOWER_BYTES).decode())).items():
                    word = slipped(run, start)
                    if len(word) >= SHORTEST:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
    if held:
        yield out()


def words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all texts: counted in each task first, so that a word of any frequency is a few rows when words meet."""
    counts = df.select(col(id_col).cast("string").alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(_count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


# ---- bigrams ----


def spelled(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all words, one after the other, the words' starts and their lengths."""
    letters = np.frombuffer("".join(batch).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) for w in batch])
    return letters, np.cumsum(sizes) - sizes, sizes


def bigrams(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, position and code of each bigram."""
    number = np.where(letters < 128, letters - 97, letters - 0xC0 + 26)
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(of[1:] == of[:-1])
    return of[at], at - starts[of[at]], number[at] * ALPHABET + number[at + 1]


def _gram_counts(batches):
    total = np.zeros(ALPHABET * ALPHABET, np.int64)
    for batch in batches:
        of, _, code = bigrams(*spelled(batch.column(0).to_pylist()))
        pairs = np.unique(of * len(total) + code)
        total += np.bincount(pairs % len(total), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


def gram_counts(vocabulary: DataFrame) -> np.ndarray:
    """The number of words that have each bigram: 8,100 numbers, whatever the vocabulary."""
    total = np.zeros(ALPHABET * ALPHABET, np.int64)
    for r in vocabulary.select("word").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        total[r.gram] = r.n
    return total


def disjoint_pair(at: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of places in ascending order and their costs, the two columns of least summed cost whose places are two or more apart.

    best[j]: the cheapest single gram among the columns that end before column i; a pair ends with column i and the best before it."""
    rows = np.arange(len(at))
    least, first, second = np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(at), int), np.zeros(len(at), int)
    for i in range(1, at.shape[1]):
        best, by = np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(at), int)
        for j in range(i):
            better = (at[:, i] - at[:, j] >= 2) & (cost[:, j] < best)
            best[better], by[better] = cost[better, j], j
        there = best < np.iinfo(np.int64).max
        total = np.where(there, np.where(there, best, 0) + cost[:, i], least)
        better = there & (total < least)
        least[better], first[better], second[better] = total[better], by[better], i
    return at[rows, first], at[rows, second]


def ordered(batch: list[str], counts: np.ndarray):
    """Spelled words; their first five bigrams (or fewer) by (rank, position) as word, position; the rank of the third; the two pivots."""
    letters, starts, sizes = spelled(batch)
    of, at, code = bigrams(letters, starts, sizes)
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    order = np.lexsort((at, rank[code], of))
    of, at, code = of[order], at[order], code[order]
    begin = np.searchsorted(of, np.arange(len(sizes)))
    place = np.arange(len(of)) - begin[of]
    last = rank[code[begin + 2]]
    three = begin[:, None] + np.arange(3)
    by_place = np.take_along_axis(three, np.argsort(at[three], 1), 1)
    pivots = disjoint_pair(at[by_place], counts[code[by_place]])
    near = (place < 5) & (rank[code] <= last[of])
    return letters, starts, sizes, of[near], at[near], last, pivots


def keys(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, of: np.ndarray, at: np.ndarray, differences: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a bigram at `at` in word `of`, as those of the same bigram in a word that is longer by each of `differences`: (key, row of `of`).

    Four for each: edit behind or before the bigram, and the half of that side, as the other word has it, that the edit left alone.
    There are fewer pivots than other first bigrams, so that the pivots have keys for all three lengths and the others for their own."""
    prefix = prefix_hashes(letters)
    begin, size = starts[of], sizes[of]
    found, row = [], []
    for d in differences:
        m = size + d
        for side in range(2):
            # the bigram's place in the other word, and the length of the side with the edit: behind it or before it
            p = at if side == 0 else at + d
            side_size = m - p - 2 if side == 0 else p
            half = side_size // 2
            own = size - at - 2 if side == 0 else at
            for part in range(2):
                kept = half if part == 0 else side_size - half
                ok = np.flatnonzero((p >= 0) & (side_size >= 0) & (kept <= own))
                b, s, k, a = begin[ok], size[ok], kept[ok], at[ok]
                if side == 0:
                    left, right = a + 2 + (k if part == 0 else 0), (k if part == 1 else 0)
                else:
                    left, right = (k if part == 0 else 0), s - a + (k if part == 1 else 0)
                key = span_hashes(prefix, b, b + left) * _SALT[0] + span_hashes(prefix, b + s - right, b + s) * _SALT[1] + p[ok].astype(np.uint64) * _SALT[2] + m[ok].astype(np.uint64) * _SALT[3]
                found.append(mixed(key + np.uint64(2 * side + part)))
                row.append(ok)
    return np.concatenate(found), np.concatenate(row)


def parities(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits of each word: which of 32 classes of letters, and of 32 classes of bigrams, it has an odd number of."""
    of, _, code = bigrams(letters, starts, sizes)
    one = np.uint64(1)
    own = np.bitwise_xor.reduceat(one << (letters.astype(np.uint64) % np.uint64(32)), starts)
    pairs = np.bitwise_xor.reduceat(one << (np.uint64(32) + mixed(code.astype(np.uint64)) % np.uint64(32)), np.searchsorted(of, np.arange(len(sizes))))
    return own ^ pairs


def _alike(a: str, b: str):
    """Whether two words' parities differ as one edit lets them: in two letters and four bigrams at most."""
    turned = F.col(a).bitwiseXOR(F.col(b))
    return (F.bit_count(turned.bitwiseAND(F.lit(0xFFFFFFFF))) <= 2) & (F.bit_count(F.shiftrightunsigned(turned, 32)) <= 4)


def _keyed(counts: np.ndarray, pivots: bool):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(1).to_numpy()
            texts = batch.column(0).to_pylist()
            for lo, hi in slices([4 * len(w) for w in texts], 400_000):
                letters, starts, sizes, of, at, last, two = ordered(texts[lo:hi], counts)
                if pivots:
                    of, at = np.tile(np.arange(len(sizes)), 2), np.concatenate(two)
                key, row = keys(letters, starts, sizes, of, at, (-1, 0, 1) if pivots else (0,))
                word, parity = of[row], parities(letters, starts, sizes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[lo:hi][word]), pa.array(last[word]), pa.array(parity[word])], ["key", "id", "last", "parity"])

    return run


# ---- near words, forms and roots ----


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for the words of vocabulary (id, word, n) that are one edit apart, each pair both ways."""
    counts = gram_counts(vocabulary)
    schema = "key long, id long, last long, parity long"
    pivots, grams = (vocabulary.select("word", "id").mapInArrow(_keyed(counts, p), schema).alias(a) for p, a in ((True, "p"), (False, "g")))
    met = pivots.join(grams, (F.col("p.key") == F.col("g.key")) & (F.col("p.last") <= F.col("g.last")) & (F.col("p.id") != F.col("g.id")) & _alike("p.parity", "g.parity"))
    pairs = met.select(F.least("p.id", "g.id").alias("a"), F.greatest("p.id", "g.id").alias("b")).distinct()
    one, two = (vocabulary.select(F.col("id").alias(x), F.struct("word", "n").alias(f"w{x}")) for x in "ab")
    near = pairs.join(one, "a").join(two, "b").where(F.levenshtein("wa.word", "wb.word", 1) == 1)
    both = F.explode(F.array(F.struct(F.col("wa").alias("x"), F.col("wb").alias("y")), F.struct(F.col("wb").alias("x"), F.col("wa").alias("y"))))
    return near.select(both.alias("s")).select("s.x.word", "s.x.n", F.col("s.y.word").alias("other"), F.col("s.y.n").alias("other_n"))


def forms(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n), only of words with a near one."""
    # the nearest word of largest n, of equal ones the first by bytes, which is code-point order
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    found = near_words(vocabulary).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    fits = -F.col("best.n") >= 2 * F.col("n")
    return found.select("word", "n", "n_near", F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Each round doubles the way that is followed, and as a form's n is at
    least twice its word's, seven rounds are enough for any counts."""
    top, spark = work_dir(links.sparkSession), links.sparkSession
    now, n = written(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), f"{top}/0"), 0
    while now.where("moved").limit(1).count():
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        now, n = written(step, f"{top}/{n + 1}"), n + 1
        remove(spark, top, f"{n - 1}")
    return now.select("word", "root")


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of df's texts that have SHORTEST code points and LEAST occurrences.

    Null and empty texts have no words, a null id stands as an empty one, repeated rows count again, other columns are not read. A
    text of one letter run of any length is one run. An empty table gives no rows. Of near words of equal n the smallest is the form."""
    top = work_dir(df.sparkSession)
    vocabulary = numbered(words(df, id_col, text_col), "id", f"{top}/words")
    found = written(forms(vocabulary), f"{top}/forms")
    followed = roots(found.where("form is not null").select("word", "form"))
    got = vocabulary.drop("id").join(found.drop("n"), "word", "left").join(followed, "word", "left")
    return got.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
