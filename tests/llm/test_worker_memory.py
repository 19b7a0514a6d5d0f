"""What Python workers hold beside their executor."""

import gc
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import bitmaps, bpe, simhash


def names(plan: str) -> list[str]:
    """Nodes of an optimized plan, from the top, without those that add no Python worker."""
    found = [x.lstrip(" :+-").split("(")[0].split(" ")[0] for x in plan.splitlines() if x.strip()]
    return [n for n in found if n not in ("Project", "Filter")]


def test_near_copies_have_one_python_node_a_stage(spark, monkeypatch):
    """A second one in a stage gives each task a second worker, which lives on beside the executor."""
    nodes, plans = ("MapInArrow", "PythonMapInArrow"), []
    written = simhash.written

    def seen(df, name):
        plans.append(names(df._jdf.queryExecution().optimizedPlan().toString()))
        return written(df, name)

    monkeypatch.setattr(simhash, "written", seen)
    text = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(i, f"{text} {i}") for i in range(5)] + [(9, "a b c d e f g")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == {**dict.fromkeys(range(5), 0), 9: 9}
    assert any(n in nodes for p in plans for n in p)
    assert not [p for p in plans for a, b in zip(p, p[1:], strict=False) if a in nodes and b in nodes]


@pytest.mark.parametrize("most", [bitmaps.MOST_BITS, 0])
def test_filtered_then(spark, monkeypatch, most):
    monkeypatch.setattr(bitmaps, "MOST_BITS", most)
    rows, keys = spark.range(1_000).selectExpr("concat('t', id) AS text", "xxhash64(id) AS k"), spark.range(3).selectExpr("xxhash64(id) AS k")

    def lengths(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["t"])

    got = [r.t for r in bitmaps.filtered(rows, "k", keys, lengths, "t string").collect()]
    assert {"t0", "t1", "t2"} <= set(got) and len(got) < 100


class Context:
    partitionId = staticmethod(lambda: 2)  # noqa: N815


def blocks(monkeypatch, texts, words_wanted, block_bytes=bpe.BLOCK_BYTES):
    monkeypatch.setattr(bpe.TaskContext, "get", staticmethod(lambda: Context))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    return bpe._blocks(public_tokenizers.PATTERN, block_bytes, words_wanted, pa.int64())(iter([batch]))


def test_words_of_a_block_are_no_objects(monkeypatch):
    """A block of distinct words takes a few bytes for each of its bytes; an object and a place in a dictionary for each word took about 12."""
    texts = [" ".join(f"w{i * 1000 + j:07d}" for j in range(1_000)) for i in range(600)]
    gc.collect()
    tracemalloc.start()
    most, n = 0, 0
    try:
        for batch in blocks(monkeypatch, texts, True):
            n += len(batch)
            most = max(most, tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes())
    finally:
        tracemalloc.stop()
    assert n == 600_002 + 1  # the numbers, the letter with and without a blank before it, and the digest
    assert most < 8 * sum(map(len, texts))


@pytest.mark.parametrize("block_bytes", [1, 300, 2_000, bpe.BLOCK_BYTES])
@pytest.mark.parametrize("part", [1, 50, 1 << 19])
def test_numbers_of_a_block(monkeypatch, block_bytes, part):
    """Sequences and words give the texts back, in any parts."""
    monkeypatch.setattr(bpe, "SLICE", part)
    monkeypatch.setattr(bpe, "PARTS", 2)
    texts = [*[f"alpha{i % 11} beta{i % 7} gamma {i}" for i in range(60)], "", None, "é \0 中文", "a" * 500, ""]
    words, got, digests = {}, {}, [{}, {}]
    for b in blocks(monkeypatch, texts, True, block_bytes):
        for r in b.to_pylist():
            if r["number"] >= 0:
                assert words.setdefault((r["block"], r["number"]), r["word"]) == r["word"]
            else:
                digests[0][r["block"]] = r["word"]
    for b in blocks(monkeypatch, texts, False, block_bytes):
        for r in b.to_pylist():
            if not r["ids"]:
                digests[1][r["block"]] = r["sequence"]
                continue
            numbers, at = bpe._unpacked(r["sequence"], sum(r["lengths"])).tolist(), 0
            for i, n in zip(r["ids"], r["lengths"], strict=True):
                got[i] = b"".join(words[r["block"], x] for x in numbers[at : at + n]).decode()
                at += n
    assert got == {i: t or "" for i, t in enumerate(texts)} and digests[0] == digests[1] and digests[0]
    assert len(words) == len({(b, w) for (b, _), w in words.items()})  # each once a block
