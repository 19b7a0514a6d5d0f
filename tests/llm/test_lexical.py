"""Ranked lexical search against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs, items, k=10):
    held = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    held = [(i, len(t), Counter(t)) for i, t in held if t]
    n, total = len(held), sum(x[1] for x in held)
    df = Counter(t for _, _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for q, text in sorted(set(items), key=str):
        terms, scored = set(TERM.findall((text or "").translate(LOW))), []
        for i, size, c in held:
            m = 100 - 90 + 90 * size * n // total
            if score := sum(weight[t] * (1_000_000_000 * c[t] // (1_000 * c[t] + 8 * m)) for t in terms if t in c):
                scored.append((-score, i is not None, i or 0))
        out += [(q, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, **more):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("terms", F.lit(1)).withColumn("item", F.lit(2))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0))
    return sorted((tuple(r) for r in lexical.ranked(d.repartition(3), i, **more).collect()), key=str)


def texts(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "naïve", "X1", "日本"]
    odds = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(r.choices(words, odds, k=r.choice((1, 5, 40, 200)))) for _ in range(n)]


def test_random_texts_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(lexical, "RANGE", 20)
    docs = list(enumerate(texts(1, 400)))
    items = list(enumerate(texts(2, 30)))
    assert got(spark, docs, items) == expected(docs, items)
    assert got(spark, docs, items, k=3, block=7) == expected(docs, items, 3)


def test_odd_rows(spark):
    """Ties by id, repeated rows, nulls, texts without terms, a very long text, repeated items, an item of unknown terms."""
    docs = [(i, "Alpha beta, gamma") for i in range(30)] + [(None, "alpha beta gamma")] * 2 + [(3, "ALPHA")] * 12 + [(40, None), (41, ""), (42, "?! --"), (43, "alpha " * 200_000 + "delta"), (44, "ÄLPHA alpha_beta")]
    items = [(1, "alpha"), (1, "alpha"), (1, "gamma delta"), (2, "nothing here"), (3, None), (4, ""), (None, "beta"), (5, "ÄLPHA")]
    assert got(spark, docs, items) == expected(docs, items)


def test_empty(spark):
    assert got(spark, [], [(1, "a")]) == got(spark, [(1, "a")], []) == got(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_spare_work_and_lose_nothing():
    """Buckets of descending lengths: the same best ones as from all scores, while most documents are never scored."""
    r = np.random.default_rng(3)
    terms, n, k = 200, 6_000, 10
    odds = 1 / np.arange(1, terms + 1)
    weight = np.floor(1_000 * np.log(2 / odds * 3)).astype(np.int64)
    vectors = [np.unique(r.choice(terms, r.integers(1, 30), p=odds / odds.sum())) for _ in range(n)]
    values = [r.integers(1, 1_000_000, len(v)) for v in vectors]
    queries = [np.unique(r.choice(terms, 6)) for _ in range(40)]
    for i in range(480):  # documents that hold an item
        vectors[i], values[i] = queries[i % 40], r.integers(700_000, 1_000_000, len(queries[i % 40]))
    lengths = np.array([np.sqrt((weight[v] * x.astype(float) ** 2).sum()) for v, x in zip(vectors, values, strict=True)])
    items = lexical.Items(pa.array(range(40)), np.arange(terms, dtype=np.uint64), np.arange(terms, dtype=np.uint64), np.r_[0, np.cumsum([len(q) for q in queries])], np.concatenate(queries))
    norms = np.sqrt([weight[q].sum() for q in queries])
    best, looked, scored, order = lexical.Best(40, k, np.zeros(40, np.int64)), 0, 0, np.argsort(-lengths)
    for i in range(0, n, 200):
        rows = order[i : i + 200]
        offsets = np.r_[0, np.cumsum([len(vectors[d]) for d in rows])]
        a, b = lexical.search(lexical.Postings.of(rows, lengths[rows], offsets, np.concatenate([vectors[d] for d in rows]), np.concatenate([values[d] for d in rows])), items, weight, norms, best)
        looked, scored = looked + a, scored + b
    for q, terms_of in enumerate(queries):
        every = sorted((-sum(int(weight[t]) * int(x) for t, x in zip(vectors[d], values[d], strict=True) if t in set(terms_of)), d) for d in range(n))[:k]
        assert [(-s, d) for s, d in zip(best.scores[q], best.ids[q], strict=True)] == every
    able = sum(bool(set(q) & set(v)) for q in map(np.ndarray.tolist, queries) for v in map(np.ndarray.tolist, vectors))
    assert scored < able / 2 and looked < 40 * n / 200


def test_feasible_coordinates():
    r = np.random.default_rng(4)
    for _ in range(300):
        q, d = np.abs(r.normal(size=(2, 5)))
        q, d = q / np.linalg.norm(q), d / np.linalg.norm(d)
        low, high = lexical.feasible(q, float(q @ d))
        assert (d >= low).all() and (d <= high).all()
