r"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each text. The ledger holds the measurements and, in `failed`, one bit for each failed
rule. Policies name a version and the rules it applies; a text is kept if it fails none of them. Ablations count, by
bitwise aggregation over the ledger alone, what each rule of a policy rejects and what it rejects alone.

Words are runs of other bytes than white space (\x20, \x09-\x0D). Null and empty texts have no words and fail few_words.
Repeated rows are each judged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import col, map_texts, others

SYMBOLS = b"#*$%&|<>"
#: Bytes that are neither white space nor UTF-8 continuations, i.e. one for each code point in words.
_STARTS = bytes(b for b in range(256) if b & 0xC0 != 0x80 and b not in b" \t\n\r\x0b\x0c")
_NOT_STARTS = bytes(b for b in range(256) if b not in _STARTS)
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_ASCII_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs")
OUT = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])

#: Rule name to its test on the measurements, true where it fails. A rule's bit is its place here; new rules go last.
RULES = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > 3 * m["n_words"],
    "dup_lines": lambda m: 10 * m["n_dup_lines"] > 5 * m["n_lines"],
    "shouting": lambda m: (10 * m["n_upper"] > 5 * m["n_letters"]) & (2 * m["n_bangs"] > m["n_words"]),
    "word_length": lambda m: (m["word_chars"] > 25 * m["n_words"]) | (2 * m["word_chars"] < 3 * m["n_words"]),
}
BASE = ("few_words", "repeated_words")
#: Version to the rules that it applies.
POLICIES = {"base": BASE, "v1": tuple(RULES)}


def mask_of(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def repeated(words: list[bytes], ids: dict[bytes, int]) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    if len(ids) >> 21:
        w = np.unique(w, return_inverse=True)[1].astype(np.int64)
    if int(w.max()) >> 21:
        pair = np.unique(w[:-1] << 32 | w[1:], return_inverse=True)[1].astype(np.int64)
        key = pair[:-1] << 32 | w[2:]
    else:
        key = w[:-2] << 42 | w[1:-1] << 21 | w[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, key)
    hit = twice[np.minimum(at, len(twice) - 1)] == key
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def measure(texts: list[bytes]) -> dict:
    out = {m: [] for m in MEASURES}
    ids: dict[bytes, int] = {}
    for t in texts:
        words = t.split()
        seen, dup, n_lines = set(), 0, 0
        for line in t.split(b"\n"):
            if line and not line.isspace():
                n_lines += 1
                dup += line in seen
                seen.add(line)
        letters = t.translate(None, _NOT_ASCII_LETTER)
        values = (len(words), len(t.translate(None, _NOT_STARTS)), len(t.translate(None, _NOT_SYMBOLS)), dup, repeated(words, ids), n_lines, len(letters.translate(None, _NOT_UPPER)), len(letters), t.count(b"!"))
        for m, v in zip(MEASURES, values, strict=True):
            out[m].append(v)
    return out


def ledger(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all but the text, if None), the measurements, and failed: the bits of the failed rules."""
    got = map_texts(docs, text_col, others(docs, text_col) if keep is None else keep, OUT, lambda: measure)
    values = {m: F.col(m) for m in MEASURES}
    bits = [F.when(test(values), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, test in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return got.withColumn("failed", failed)


def apply_policy(rows: DataFrame, version: str, out_col: str = "kept") -> DataFrame:
    """rows of ledger() with out_col: whether none of the policy's rules failed."""
    return rows.withColumn(out_col, F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[version]))) == 0)


def ablation(rows: DataFrame, version: str) -> DataFrame:
    """For each rule of the policy: n_failed, n_failed_alone (kept again if the rule goes) and n_kept_without."""
    whole = mask_of(POLICIES[version])
    bad = F.col("failed").bitwiseAND(F.lit(whole))
    # one row of counts for each pattern of bits, of which there are at most 2 ** len(RULES)
    patterns = rows.groupBy(bad.alias("bad")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of([r])).cast("long").alias("bit")) for r in POLICIES[version]])
    each = patterns.select("bad", "n", F.explode(rules).alias("r"))
    hit = F.col("bad").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("bad").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(total(hit).alias("n_failed"), total(hit & (rest == 0)).alias("n_failed_alone"), total(rest == 0).alias("n_kept_without"))


def digest(rows: DataFrame, version: str = "v1") -> DataFrame:
    """n_words, the four base measurements, base_failed and kept per row of ledger()."""
    extra = [c for c in rows.columns if c not in (*MEASURES, "failed")]
    base = F.col("failed").bitwiseAND(F.lit(mask_of(BASE))) != 0
    judged = apply_policy(rows, version)
    return judged.select(*[col(c) for c in extra], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "failed")
