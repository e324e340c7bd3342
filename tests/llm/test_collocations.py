"""Collocations against brute force, and the filters' round trips."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tallyloom.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, w int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = {}
    frequent = {k: v for k, v in f.items() if v >= least and len(k) > 2}
    most = Counter()
    for (lang, *w), v in frequent.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = (lang, *w[i : i + m])
                most[key] = max(most[key], v)
    for key, a in frequent.items():
        lang, *w = key
        score, _, l, r = min((int(Fraction(2000000 * a, f[(lang, *w[:k])] + f[(lang, *w[k:])])), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        if 100 * most[key] < 80 * a:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, got in out.items() for i, (s, a, p, l, r) in enumerate(sorted(got)[:top], 1)}


def texts(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abÉß") for _ in range(r.randint(1, 3))) for _ in range(25)] + ["New", "york", "city", "hall"]
    out = []
    for i in range(150):
        w = r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randint(0, 60))
        for _ in range(3):
            w[(at := r.randint(0, len(w))) : at] = ["New", "York", "City", "Hall"][: r.choice((2, 3, 4, 4))]
        out.append(("".join(x + r.choice((" ", " ", " ", "\t ", ", ", ".", "\r\n", "\x0b")) for x in w), r.choice(("en", "en", "de", None, "und"))))
    return out + [(None, "en"), ("", None), (" \t\n..", "en"), ("a a a a a a a " * 40, "fr"), ("one.two", "en"), ("x y z " * 5000, "de"), ("\x00 \x1c \x00", "en")]


@pytest.mark.parametrize(("seed", "least", "top", "chunk"), [(1, 5, 2000, 2_000_000), (2, 30, 40, 700), (3, 2, 7, 90)])
def test_against_brute_force(spark, seed, least, top, chunk):
    """Many small chunks give what one large one gives."""
    rows = texts(seed)
    rows += rows[:20]
    df = spark.createDataFrame([(i, t, g, "own", 1) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    got = C.mine(df, top=top, least=least, full=chunk).collect()
    assert {tuple(r) for r in got} == brute(rows, least, top)
    assert len(got) == len({(r.lang, r["rank"]) for r in got}) > 5


def test_empty_table_and_nothing_frequent(spark):
    assert C.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.mine(spark.createDataFrame([(1, "a b c", "en", "", 0)], SCHEMA)).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 2**62
    phrases = spark.createDataFrame([([1], big + 1), ([2], big), ([1, 2], big - 1)], "w array<long>, n long")
    got = C.scored(phrases).first()
    assert (got.a, got.l, got.r, got.score) == (big - 1, big + 1, big, 2000000 * (big - 1) // (2 * big + 1))
    assert [r.a for r in C.uncovered(C.scored(phrases), phrases).collect()] == [big - 1]


@pytest.mark.parametrize("k", [2, 3, 4])
@pytest.mark.parametrize("bits", [1, 3, 17, 32])
def test_filters_lose_nothing(k, bits):
    r = np.random.default_rng(k * bits)
    codes = r.integers(0, 1 << min(bits, 6 if k == 2 else 4), 5000).astype(np.uint32) << np.uint32(max(bits - 6, 0))
    high, low, counts, at, which = C.tally(codes, k, bits)
    want = Counter(tuple(codes[i : i + k].tolist()) for i in range(len(codes) - k + 1) if codes[i : i + k].all())
    wide = C.widths(k, bits)
    words = [x.tolist() for x in C.unpacked(*C.permuted(high, low, wide, back=True), k, bits)]
    assert dict(zip(zip(*words, strict=True), counts.tolist(), strict=True)) == want
    counts = counts * r.choice([1, 1, 7, 300, 10**12], len(counts))
    known = min(2, bits)
    for shard in range(1 << known):
        own = (high >> np.uint64(wide[0] - known)) == shard
        body = C.filter_of(high[own], low[own], counts[own], wide, known)
        for x, y in zip(C.entries_of(body, wide, known, shard), (high[own], low[own], counts[own]), strict=True):
            assert np.array_equal(x, y)


def test_filters_are_compact_and_merge():
    r = np.random.default_rng(5)
    wide, parts, want = (20, 20), [], Counter()
    for _ in range(4):
        high, low = C.permuted(*(r.integers(0, 1 << 20, 100_000).astype(np.uint64) for _ in range(2)), wide)
        keys = np.unique(high << np.uint64(20) | low)
        high, low, counts = keys >> np.uint64(20), keys & np.uint64((1 << 20) - 1), np.ones(len(keys), np.int64)
        body = C.filter_of(high, low, counts, wide, 0)
        assert len(body) < 4 * len(keys)  # 40 bits less the quotient, two for the runs and one for the counter
        parts.append(C.entries_of(body, wide, 0, 0))
        want.update(keys.tolist())
    parts.append(parts[0])
    want.update((parts[0][0] << np.uint64(20) | parts[0][1]).tolist())
    high, low, counts, which = C.merged(parts, wide)
    assert dict(zip((high << np.uint64(20) | low).tolist(), counts.tolist(), strict=True)) == want
    assert np.array_equal(high[which], np.concatenate([p[0] for p in parts]))


def test_longer_runs():
    codes = np.array([1, 2, 3, 4, 0, 5, 6, 7, 8, 9], np.uint32)
    frequent = np.array([1, 1, 0, 0, 0, 1, 0, 1, 1, 0], bool)
    assert C.longer_runs(codes, 2, frequent).tolist() == [1, 2, 3, 0, 7, 8, 9, 0]
