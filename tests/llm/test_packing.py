"""Best-fit packing: what a packing has to be, and how near it is to best-fit decreasing, one row after another."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing


def one_by_one(sizes, capacity):
    """The number of sequences that best-fit decreasing opens."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        best = min(fits, default=None)
        if best is None:
            rooms.append(capacity - s)
        else:
            rooms.remove(best)
            rooms.append(best - s)
    return len(rooms)


def sequences(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in held.values():
        v.sort()
        assert [o for o, _ in v] == [0, *np.cumsum([n for _, n in v])[:-1]] and sum(n for _, n in v) <= capacity
    return len(held)


SIZES = {
    "even": lambda r: r.randint(1, 100),
    "small": lambda r: r.choice((1, 2, 3, 5)),
    "hot": lambda r: 34 if r.random() < 0.4 else r.randint(1, 100),
    "large": lambda r: r.randint(45, 100),
}


@pytest.mark.parametrize("kind", SIZES)
@pytest.mark.parametrize("size_of_range", [60, 200_000])
def test_best_fit(spark, monkeypatch, kind, size_of_range):
    monkeypatch.setattr(packing, "RANGE", size_of_range)
    r = random.Random(5)
    sizes = [SIZES[kind](r) for _ in range(800)]
    rows = packing.best_fit(spark.createDataFrame(list(enumerate(sizes)), "n long, length long"), capacity=100).collect()
    assert sorted((x.n, x.length) for x in rows) == list(enumerate(sizes))
    want = one_by_one(sizes, 100)
    used = sequences(rows, 100)
    assert used == want if size_of_range > 800 else used <= want + max(2, 0.03 * want)


def test_new_sequences():
    r = random.Random(6)
    for _ in range(60):
        sizes = [r.randint(1, r.choice((5, 20, 40))) for _ in range(r.randint(0, 60))]
        assert packing.new_sequences(np.bincount(sizes, minlength=41), np.zeros(41, int)) == one_by_one(sizes, 40)
    assert packing.new_sequences(np.bincount([5, 5, 5], minlength=11), np.bincount([5, 7], minlength=11)) == 1


def test_shared_out():
    """The nearest gaps above go first, to the largest rows; a gap takes as many rows as are sure to fit."""
    ways = packing.shared_out([(0, 0, 0, 2, 100), (1, 1, 60, 3, 50), (2, 9, 20, 0, 0), (3, 4, 10, 0, 0)])
    assert ways == [(1, 0, 1, 0, 0, 1), (2, 0, 6, 1, 0, 2), (2, 6, 9, 0, 1, 5)]
    assert packing.shared_out([(0, 5, 10, 1, 30)]) == []


def test_odd_rows(spark):
    """Repeated rows, null ids, columns called like those of the operator; sizes out of range; empty tables."""
    rows = [(None, 3, "a")] * 5 + [(1, 10, None)] * 4 + [(1, 1, "")]
    df = spark.createDataFrame(rows, "id long, length long, size string").withColumn("kind", F.lit(9)).withColumn("part", F.lit(0)).withColumn("sequence_id", F.lit("x")).withColumn("row", F.lit(2))
    out = packing.best_fit(df, capacity=10)
    assert out.columns == ["id", "length", "size", "kind", "part", "row", "sequence_id", "offset"]
    found = out.collect()
    assert Counter((r.id, r.length, r["size"]) for r in found) == Counter(rows) and sequences(found, 10) == 6
    for bad in (0, 11, None):
        with pytest.raises(ValueError):
            packing.best_fit(spark.createDataFrame([(bad,)], "length long"), capacity=10)
    assert packing.best_fit(spark.createDataFrame([], "length long"), capacity=10).collect() == []


def test_cut():
    assert packing.cut(10, 10) == [10] and packing.cut(1, 10) == [1] and packing.cut(20, 10) == [10, 10] and packing.cut(25, 10) == [5, 10, 10]


def test_pieces(spark):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", "a b", "word " * 3_000, "Ünïcode " * 700, "a b"]
    df = spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("length", F.lit("x"))
    found = {}
    for r in packing.pieces(df, path, 2, capacity=1024).collect():
        found.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    library = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids, want, at = [*library.encode(t or "", add_special_tokens=False).ids, 2], [], 0
        for p, n in enumerate(packing.cut(len(ids), 1024)):
            want.append((p, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
        assert sorted(found[i or None]) == want
