"""The Merkle manifest against a tree built by plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, ranks


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """(root, the siblings of each node up to it)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for w, i in zip(ways, at, strict=True):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            w.append((run[: i % 8], run[i % 8 + 1 :]))
        nodes, at = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], ways


def expected(rows, seen=lambda r: r):
    """rows: (id, group, text). As sorted tuples of the digest columns."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names]
    root, over = climb([t[0] for t in trees])
    out = []
    for g, (subroot, ways), above in zip(names, trees, over, strict=True):
        for (_, _, own, r), way in zip(sorted(groups[g], key=lambda x: x[:3]), ways, strict=True):
            proof = "".join("".join(a + b) for a, b in way + above)
            top = leaf(seen(r))
            for a, b in way + above:
                top = h("".join([*a, top, *b]))
            out.append((str(r[0]), own, subroot, root, h(proof), top, top == root))
    return sorted(out)


def got(spark, rows, shown=None):
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("rank", F.lit(1)).withColumn("g", F.lit("x")).withColumn("digest", F.lit(None).cast("int"))
    out = merkle.proofs(df.repartition(3), ["doc_id", "lang", "text"], "lang", "doc_id", shown=shown, schema=merkle.DIGESTS)
    return sorted((str(r.id), *r[1:]) for r in out.collect())


@pytest.mark.parametrize("n", [1, 2, 9, 600])
def test_sizes(spark, n):
    """A group of n rows, beside others of one and of eight rows, a null group and an empty name."""
    rows = [(i, "en", f"Text {i}") for i in range(n)] + [(3, None, "x")] + [(i, "", "é" * i) for i in range(8)] + [(7, "-", "")]
    assert got(spark, rows) == expected(rows)


def test_lone_row_and_many_groups(spark):
    assert got(spark, [(5, "en", "a")]) == expected([(5, "en", "a")])
    rows = [(i, f"g{i % 70}", "t") for i in range(150)]
    assert got(spark, rows) == expected(rows)


def test_odd_rows(spark):
    """Nulls in all columns, repeated rows, one id of many texts, a long text."""
    rows = [(None, None, None)] * 3 + [(1, "en", "same")] * 20 + [(2, "en", f"v{i % 5}") for i in range(40)] + [(9, "fr", "word " * 200_000), (9, "fr", None), (9, "fr", "")]
    assert got(spark, rows) == expected(rows)


def test_tampering(spark):
    rows = [(i, "en" if i % 3 else "de", "AbC" if i % 2 else "abc") for i in range(100)]
    found = got(spark, rows, shown=["doc_id", "lang", F.lower("text")])
    assert found == expected(rows, seen=lambda r: (r[0], r[1], r[2].lower())) and {x[-1] for x in found} == {True, False}


def test_empty_and_real_proofs(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(i, "en", "t") for i in range(20)], "doc_id long, lang string, text string")
    for r in merkle.proofs(df, ["doc_id", "lang", "text"], "lang", "doc_id").collect():
        assert merkle.folded(r.leaf, r.proof, r.lefts, r.widths) == r.root and r.verified and h(r.proof) == r.proof_sha256
        assert merkle.folded(h("other"), r.proof, r.lefts, r.widths) != r.root


def test_ranks(spark):
    """A key that a third of the rows have is dealt to more than one partition, and ranks are gapless in order."""
    df = spark.range(3_000).select(F.when(F.col("id") < 1_000, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    rows = sorted((r["rank"], r["k"]) for r in ranks.ranked(df.repartition(4), ["k"], "rank").collect())
    assert [r for r, _ in rows] == list(range(3_000)) and [k for _, k in rows] == sorted(k for _, k in rows)
