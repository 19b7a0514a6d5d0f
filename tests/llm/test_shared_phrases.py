"""Phrases that many test items share: nothing is lost, and they cost what the rest of the items makes them cost."""

import random
import time

import pyarrow as pa
import pytest

from tidemark.llm import decontaminate

PHRASE = "which of the following is".split()


def matches(items, texts):
    """(passages found, CPU seconds without what items_of takes)."""
    held = decontaminate.items_of(list(range(len(items))), [" ".join(x) for x in items], 3)

    class Shared:
        value = (held, held.table())

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([" ".join(t) for t in texts], pa.string())], ["doc_id", "text"])
    began = time.process_time()
    found = {x for b in decontaminate._matched(Shared, 3, 0.5, pa.int64())([batch]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    return found, time.process_time() - began


def edited(rng, words, rate):
    out = []
    for w in words:
        r = rng.random()
        out += [f"x{rng.randrange(999)}"] if r < rate * 0.6 else [] if r < rate * 0.8 else [w, "y"] if r < rate else [w]
    return out


@pytest.mark.parametrize("few", [0, 8])
def test_nothing_is_lost(monkeypatch, few):
    """Items of all sizes, edited copies of whole and of half items, and the phrase alone: as if every seed were followed."""
    rng = random.Random(few)
    vocabulary = [f"w{i}" for i in range(2000)]
    some = lambda n: rng.choices(vocabulary, [1 / (i + 3) for i in range(2000)], k=n)
    items = [PHRASE[: rng.randrange(3, 6)] + some(rng.choice([0, 1, 5, 12, 25, 60, 150])) for _ in range(90)] + [PHRASE * 4, ["a"] * 30, []]
    texts = [some(40) + edited(rng, item[: len(item) if j % 3 else len(item) // 2 + 3], rng.choice([0, 0.1, 0.2, 0.3])) + some(30) + PHRASE + some(20) for j, item in enumerate(items)]
    texts += [[], PHRASE, PHRASE * 100, ["a"] * 500]
    got = matches(items, texts)[0]
    monkeypatch.setattr(decontaminate, "FEW", 10**9)
    all_seeds = matches(items, texts)[0]
    monkeypatch.setattr(decontaminate, "FEW", few)
    assert matches(items, texts)[0] == all_seeds == got
    assert len({d for d, *_ in all_seeds}) >= 60


def test_a_phrase_of_20_000_items():
    """One place in 200 words of the documents; a phrase of all items costs at most as much again, and its copies are found."""
    rng = random.Random(2)
    some = lambda n: [f"w{rng.randrange(30_000)}" for _ in range(n)]
    rest = [some(rng.randrange(10, 40)) for _ in range(20_000)]
    texts = [some(195) + PHRASE for _ in range(1_500)] + [some(50) + PHRASE + x + some(50) for x in rest[::100]]
    plain, before = matches(rest, texts)
    found, after = matches([PHRASE + x for x in rest], texts)
    wanted = {(1_500 + i, 100 * i) for i in range(200)}
    assert wanted == {x[:2] for x in plain} == {x[:2] for x in found}
    assert after < 2 * before + 1, (before, after)
