"""Spelling variants against brute force: every pair of words compared, over texts of few letters with many near words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, form string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute(rows):
    n = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def texts(seed, letters, sizes):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(letters) for _ in range(r.choice(sizes))) for _ in range(150)]
    for w in list(vocabulary):
        k = r.randrange(len(w))
        vocabulary += [w[:k] + r.choice(letters) + w[k + r.choice((0, 1)) :], w[:k] + w[k + 1 :]]
    weights = [r.random() ** 4 for _ in vocabulary]
    return [" ".join(w.capitalize() if r.random() < 0.2 else w for w in r.choices(vocabulary, weights, k=60)) for _ in range(80)]


@pytest.mark.parametrize(("seed", "letters", "sizes"), [(1, "ab", (4, 5, 6, 7)), (2, "abcdeéÿ×", (5, 6, 9)), (3, "a", tuple(range(4, 30))), (4, "ÀÉxyzabcdefgh", (5, 12))])
def test_against_every_pair(spark, seed, letters, sizes):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts(seed, letters, sizes))]
    rows += rows[:3] + [(7, None), (8, ""), (9, "1 2, -"), (10, " ".join(["é" * 3000, "é" * 2999 + "x"] * 3))]
    df = spark.createDataFrame([(k, t, "extra", 5, "extra") for k, t in rows], SCHEMA).repartition(3)
    got = spelling.group(df).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len({r.word for r in got})


def test_long_chain_of_forms(spark):
    words = ["aaaaa" + "b" * k for k in range(12)]
    rows = [(k, " ".join([w] * (3 << k))) for k, w in enumerate(words)]
    got = {r.word: r for r in spelling.group(spark.createDataFrame([(k, t, "", 0, "") for k, t in rows], SCHEMA)).collect()}
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.values()} == brute(rows)
    assert max(len(r.root) - len(r.word) for r in got.values()) >= 8


def test_empty_table(spark):
    assert spelling.group(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pivots_are_the_cheapest_disjoint_pair():
    r = np.random.default_rng(3)
    at = np.sort(np.array([r.choice(9, 3, replace=False) for _ in range(200)]), 1)
    cost = r.integers(0, 50, at.shape)
    one, two = spelling.disjoint_pair(at, cost)
    for p, c, a, b in zip(at.tolist(), cost.tolist(), one.tolist(), two.tolist(), strict=True):
        of = dict(zip(p, c, strict=True))
        assert b - a >= 2
        assert of[a] + of[b] == min(of[x] + of[y] for x in p for y in p if y - x >= 2)
