"""The pipeline against a plain Python version of its stages."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, quality_model, secrets
from tidemark.llm.queries import THRESHOLD, quality_trees

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def expected(spark):
    import tiktoken

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    trees = quality_trees(spark, SF, spark.read.parquet(f"{SF}/documents.parquet"))

    def score(text):
        raw = text.encode()
        return trees.score(quality_model.statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))[0]

    left = {i: r for i, r in docs.items() if score(r.text) >= THRESHOLD}

    def shingles(text, k=5):
        w = text.encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    # Near copies: five-word Jaccard of 0.8 or more, and what such pairs join; the smallest id stays.
    sets = {i: shingles(r.text) for i, r in left.items()}
    parent = {i: i for i in left}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in left:
        for b in left:
            if a < b and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    left = {i: r for i, r in left.items() if root(i) == i}

    def words(text):
        raw = text.lower().encode()
        return decontaminate._hashed(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]

    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [set(zip(w, w[1:], w[2:])) for w in items]

    def leaks(text):
        w = words(text)
        mine = set(zip(w, w[1:], w[2:]))
        return any(mine & g and decontaminate.align(x, w)[0] >= 0.5 * 2 * len(x) for x, g in zip(items, grams))

    left = {i: r for i, r in left.items() if not leaks(r.text)}
    owners = {}
    weak = {i: secrets.weak_spans(r.text, secrets.base_spans(r.text)) for i, r in left.items()}
    for i, spans in weak.items():
        for h in [s[2] for s in spans] + [s[3] for s in secrets.valued_spans(left[i].text)]:
            owners.setdefault(h, set()).add(left[i].source)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for i, r in left.items():
        spans = secrets.base_spans(r.text) + [("owned", a, b) for a, b, h in weak[i] if len(owners[h]) == 1]
        text, at = "", 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if b > at:
                text, at = text + r.text[at : max(at, a)] + f"<|{kind}|>", b
        text += r.text[at:]
        ids = encoding.encode_ordinary(text)
        out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return docs, out


def test_run(spark, expected):
    docs, want = expected
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert 0 < len(want) < len(docs)
    assert got == want


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, spans int, component_id long, _text string"
    rows = [(None, None, None, None, None, 1.0, 1, 1, "x"), (1, "", "en", "s", 0, None, 1, 1, "x"), (2, "some words here " * 9, "en", "s", 9, 1.0, 1, 1, "x"), (2, "some words here " * 9, "en", "s", 9, 1.0, 1, 1, "x"), (3, "w " * 30_000, "en", "s", 9, 1.0, 1, 1, "x")]
    for data in (rows, []):
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, spark.createDataFrame(data, schema), SF)
            got = df.collect()
            assert len(got) <= len(data)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert df.columns == spark.createDataFrame(data, schema).columns
            if name == "SimHash near-dedup" and data:
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in got)[:3] == [(False, 1), (False, 2), (False, 3)]


def test_rows_are_known_by_id_and_text(spark):
    """Rows that share an id with a copy, or have none, stay unless they are copies themselves."""
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(3, words[0]), (7, words[0]), (7, words[1]), (None, words[0]), (None, words[2]), (9, words[3]), (9, words[3]), (4, words[0] + " tail"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([(3, words[0]), (7, words[1]), (None, words[2]), (9, words[3]), (5, None)], key=str)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(1, item), (1, words[0]), (None, item), (None, words[1]), (2, "x " + item)]], schema)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, words[0]), (None, words[1])], key=str)
