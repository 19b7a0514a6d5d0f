"""The candidate search of near copies: what it finds, what it leaves alone, and names of sets."""

import numpy as np
import pyarrow as pa

from tidemark.llm import simhash
from tidemark.llm.common import components


def keys_by_word(prints):
    """For each text the set of its keys over all key words."""
    out = [set() for _ in prints]
    for w in range(prints.shape[1]):
        rows, found = simhash.keys_of(np.ascontiguousarray(prints[:, w]).view(np.int64))
        for r, f in zip(rows.tolist(), found.tolist(), strict=True):
            out[r].add((w, f))
    return out


def is_candidate(a, b):
    return sum((int(x) ^ int(y)).bit_count() for x, y in zip(a[:2], b[:2])) <= 30


def test_links_are_those_of_brute_force_over_128_bits(spark):
    rng = np.random.default_rng(8)
    rows = rng.integers(0, 1 << 62, (40, 5), dtype=np.int64)
    rows = [r.tolist() for r in rows]
    for r in list(rows):
        for bits in (3, 10, 20, 34):
            near = list(r)
            for b in rng.choice(5 * 62, bits, replace=False).tolist():
                near[b // 62] ^= 1 << b % 62
            rows.append(near)
    rows += [[r[0], r[1] ^ 0xFF, *r[2:]] for r in rows[:5]]  # one column alike, another not
    keys = keys_by_word(np.array(rows, np.int64)[:, 2:].view(np.uint64))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if keys[i] & keys[j] and is_candidate(rows[i], rows[j])]
    label = np.arange(len(rows))
    for _ in rows:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    node = {}  # texts with one fp are one node
    for r, low in zip(rows, label.tolist()):
        node.setdefault(r[0], set()).add(low)
    df = spark.createDataFrame([(r[0], r[1], r[2:]) for r in rows], "fp long, more long, words array<long>")
    keyed = df.mapInArrow(simhash._keyed_words(3), "key int, fp long, more long")
    same = lambda got: {frozenset(k for k in got if got[k] == g) for g in set(got.values())}
    merged = {}
    for f, lows in node.items():
        merged[f] = min(lows)
    assert links and all(len(x) == 1 for x in node.values())
    for block in (2_000, 3):
        found = {r.node: r.component for r in components(simhash.links_over(keyed, block, 30).filter("a <> b")).collect()}
        assert same({f: found.get(f, f) for f in node}) == same(merged)


def test_unrelated_texts_are_no_candidates(spark):
    """20,000 unrelated fingerprints: two hundred million pairs, many of which share a key, and no link. Checked by 16 of 64
    bits, a dozen of them would be linked, and a thousand times as many texts would hang together."""
    rng = np.random.default_rng(9)
    rows = rng.integers(-(1 << 63), 1 << 63, (20_000, 5), dtype=np.int64)
    near = rows[:50].copy()
    near[:, 0] ^= 0b10101
    near[:, 1] ^= 1 << 40
    near[:, 2] ^= 0b11 << 30
    words = pa.array(np.concatenate([rows, near])[:, 2:].tolist(), pa.list_(pa.int64()))
    table = pa.table({"fp": np.concatenate([rows, near])[:, 0], "more": np.concatenate([rows, near])[:, 1], "words": words})
    keyed = spark.createDataFrame(table).repartition(8).mapInArrow(simhash._keyed_words(3), "key int, fp long, more long")
    found = {frozenset((r.a, r.b)) for r in simhash.links_over(keyed, 2_000, 30).collect()}
    assert found == {frozenset((a, b)) for a, b in zip(rows[:50, 0].tolist(), near[:, 0].tolist(), strict=True)}


def test_pairs_at_the_similarity_asked_for_are_candidates():
    """Random sets with a Jaccard similarity of 0.8 and more, of few and of many shingles; of 1,500 such pairs 97 % and more were
    found at 0.8 and 99.7 % at 0.85, and the bounds leave three standard deviations of 300."""
    rng = np.random.default_rng(10)
    for n, share, least in ((60, 0.8, 0.945), (300, 0.8, 0.945), (300, 0.85, 0.985)):
        found = 0
        for _ in range(300):
            common = round(n * 2 * share / (1 + share))
            base = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            p = np.stack([simhash.set_fingerprints(np.sort(s), 5) for s in (base[:n], base[n - common :])])
            a, b = keys_by_word(p[:, 2:])
            found += bool(a & b) and is_candidate(*p)
        assert found >= least * 300, (n, share, found)


def test_sets_are_told_apart_by_128_bits():
    a, b = np.array([1, 2], np.uint64), np.array([1, 3], np.uint64)
    assert len(simhash.set_name(a)) == 16 and simhash.set_name(a) != simhash.set_name(b) and simhash.set_name(a[:0]) == simhash.set_name(b[:0])


def test_a_hot_component(spark, monkeypatch):
    """A third of the rows are distinct near copies: their component's size is broadcast, and classes stay right."""
    from tidemark.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[:100], f"x{i}", *words[101:]]) for i in range(60)] + [" ".join(f"d{i}_{j}" for j in range(30)) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (1_000, 7):
        got = {r.doc_id: r.component_id for r in simhash.near_copies(df, block=block).collect()}
        assert got == {i: 0 if i < 60 else i for i in range(180)}
