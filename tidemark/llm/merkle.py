"""A Merkle manifest of a data set: one root for all rows, and for each row a proof that it is under that root.

A row becomes a leaf: the SHA-256 of its fields, each `-` if null, else its UTF-8 byte count, a colon and its value. Within a
group leaves ascend by id; while a level has more than one node, each ARITY consecutive nodes (the last run may have fewer, even
one) become the SHA-256 of their digests, as lowercase hex text, one after another. What remains is the group's subroot. Subroots,
ordered by group (null first, then bytewise), are joined in the same way to the root.

Trees are worked on by superblocks, the ARITY ** DEPTH leaves (or nodes) under one node DEPTH levels up. On the way up a
superblock is reduced to its node, so each round leaves one row in 512. On the way down the nodes of a superblock are cogrouped
with the outer nodes it requires, the siblings on the way from its node to the root, which are one row a superblock: a task
finishes the local reduction, joins inner and outer siblings to whole proofs, and at the leaves folds them.

No superblock, proof or broadcast grows with the data but for the height of the tree; a group that holds most rows is many
superblocks. Ranks come from a range sort whose key ends in a salt.

Defined results: null and empty fields differ (`-` and `0:`); rows with a null id come first in their group; rows that share an
id are ordered by leaf, and equal rows are leaves of their own with equal digests; a null group is a group of its own; an empty
table gives no rows and has no root; a lone row is its group's subroot, and a lone subroot the root, with an empty proof; further columns are
left out of leaves unless they are named.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_classes, written
from .ranks import ranked

ARITY, DEPTH = 8, 3
BLOCK = ARITY**DEPTH
PROOFS = "id string, leaf string, subroot string, root string, proof string, proof_sha256 string, lefts array<int>, widths array<int>, folded_root string, verified boolean"
#: The columns of PROOFS without the siblings themselves, which are longer than many documents.
DIGESTS = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(column: str | Column) -> Column:
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[str | Column]) -> Column:
    """The leaf of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


def height(n: int) -> int:
    """Levels above n nodes."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def reduced(digests: list[str], n: int) -> list[list[str]]:
    """The levels of a superblock in a tree of n nodes, its own digests first, its node last."""
    levels = [digests]
    for _ in range(min(DEPTH, height(n))):
        last = levels[-1]
        levels.append([sha256("".join(last[i : i + ARITY])) for i in range(0, len(last), ARITY)])
    return levels


def inner(levels: list[list[str]]) -> tuple[list[str], list[list[int]], list[list[int]]]:
    """For each node of a superblock: its siblings, level by level and left to right; how many are left of it at each level; how many there are."""
    paths, lefts, widths = [], [], []
    for i in range(len(levels[0])):
        path, left, width = [], [], []
        for level in levels[:-1]:
            low = i // ARITY * ARITY
            run = level[low : low + ARITY]
            path += run[: i - low] + run[i - low + 1 :]
            left.append(i - low)
            width.append(len(run) - 1)
            i //= ARITY
        paths.append("".join(path))
        lefts.append(left)
        widths.append(width)
    return paths, lefts, widths


def folded(digest: str, proof: str, lefts: list[int], widths: list[int]) -> str:
    """The root that a leaf and its proof lead to."""
    at = 0
    for left, width in zip(lefts, widths, strict=True):
        middle, end = at + 64 * left, at + 64 * width
        digest, at = sha256(proof[at:middle] + digest + proof[middle:end]), end
    return digest


def _up(nodes: pd.DataFrame) -> pd.DataFrame:
    nodes, n = nodes.sort_values("p"), int(nodes["n"].iloc[0])
    top = reduced([x.hex() for x in nodes["digest"]], n)[-1][0]
    return pd.DataFrame({"g": nodes["g"].iloc[:1], "p": nodes["block"].iloc[:1], "n": [-(-n // BLOCK)], "digest": [bytes.fromhex(top)]})


def _down(subroots: bool):
    """subroots: the nodes are the groups' subroots, which all below them carry along."""

    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, above = nodes.sort_values("p"), outer.iloc[0]
        paths, lefts, widths = inner(reduced([x.hex() for x in nodes["digest"]], int(nodes["n"].iloc[0])))
        out = {"g": nodes["g"].to_numpy(), "p": nodes["p"].to_numpy(), "subroot": list(nodes["digest"]) if subroots else [above["subroot"]] * len(nodes), "path": [p + above["path"] for p in paths]}
        return pd.DataFrame(out | {"lefts": [[*x, *above["lefts"]] for x in lefts], "widths": [[*x, *above["widths"]] for x in widths]})

    return run


def _leaves(root: str, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]

    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, above = nodes.sort_values("p"), outer.iloc[0]
        leaves = [x.hex() for x in nodes["digest"]]
        paths, lefts, widths = inner(reduced(leaves, int(nodes["n"].iloc[0])))
        proofs = [p + above["path"] for p in paths]
        ways = [([*a, *above["lefts"]], [*b, *above["widths"]]) for a, b in zip(lefts, widths, strict=True)]
        shown = [leaf if x is None else x.hex() for leaf, x in zip(leaves, nodes["shown"], strict=True)]
        ends = [folded(x, p, *way) for x, p, way in zip(shown, proofs, ways, strict=True)]
        out = {"id": nodes["id"].to_numpy(), "leaf": leaves, "subroot": above["subroot"].hex(), "root": root, "proof": proofs, "proof_sha256": [sha256(p) for p in proofs]}
        out |= {"lefts": [a for a, _ in ways], "widths": [b for _, b in ways], "folded_root": ends, "verified": [e == root for e in ends]}
        return pd.DataFrame({k: out[k] for k in names})

    return run


_NODES, _OUTER = "g long, p long, n long, digest binary", "g long, p long, subroot binary, path string, lefts array<int>, widths array<int>"


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"p div {BLOCK}"))


def _risen(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """nodes (g, p, n, digest) and the nodes of each round above them, down to one a tree. largest: the most nodes a tree has."""
    rounds = [nodes]
    while largest > 1:
        below = _blocked(rounds[-1].select("g", "p", "n", "digest"))
        rounds.append(written(below.groupBy("g", "block").applyInPandas(_up, _NODES), "merkle-nodes"))
        largest = -(-largest // BLOCK)
    return rounds


def _met(nodes: DataFrame, outer: DataFrame, how, schema: str) -> DataFrame:
    """Superblocks cogrouped with the outer nodes they require."""
    return _blocked(nodes).groupBy("g", "block").cogroup(outer.withColumnRenamed("p", "block").groupBy("g", "block")).applyInPandas(how, schema)


def proofs(df: DataFrame, fields: list[str | Column], group: str, id_col: str, shown: list[str | Column] | None = None, schema: str = PROOFS) -> DataFrame:
    """A row for each row of df: its leaf, its group's subroot, the root, its proof (siblings up to the root), and the root that
    the row leads to.

    fields make the leaf. shown: the same fields of the copy that is to be verified (the row itself if not given); it is folded with the original
    siblings, and verified says whether that leads to the root. id is id_col as text. schema: PROOFS, or DIGESTS."""
    spark = df.sparkSession
    # Bytewise order with null first: a mark stands before every group's name.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaf, seen = leaf_of(fields), leaf_of(shown) if shown else F.lit(None).cast("binary")
    rows = df.select(key.alias("k"), F.col(id_col).alias("id"), leaf.alias("digest"), seen.alias("shown"))
    rows = ranked(rows.withColumn("shown", F.expr("nullif(shown, digest)")), ["k", "id", "digest"], "rank")
    groups = written(ranked(rows.groupBy("k").agg(F.min("rank").alias("first"), F.count("*").alias("n")), ["k"], "g"), "merkle-groups")
    many, largest = groups.agg(F.count("*"), F.max("n")).first()
    if not many:
        return spark.createDataFrame([], schema)
    classes = groups.select("k", "g", "first", "n", F.col("n").alias("size"))
    placed = join_classes(rows, classes, "k").select("g", (F.col("rank") - F.col("first")).alias("p"), F.col("size").alias("n"), "digest", F.col("id").cast("string").alias("id"), "shown")
    trees = _risen(placed, largest)
    subroots = trees[-1] if len(trees) > 1 else placed
    over = _risen(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("p"), F.lit(many).cast("long").alias("n"), "digest"), many)
    root = bytes(over[-1].first()["digest"])
    # The way down begins above the root, where nothing is required.
    none = F.array().cast("array<int>")
    outer = spark.range(1).select(F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("p"), F.lit(None).cast("binary").alias("subroot"), F.lit("").alias("path"), none.alias("lefts"), none.alias("widths"))
    if many == 1:
        outer = outer.withColumn("subroot", F.lit(root))
    else:
        for nodes in over[-2::-1]:
            outer = written(_met(nodes, outer, _down(nodes is over[0]), _OUTER), "merkle-outer")
        outer = outer.select(F.col("p").alias("g"), F.lit(0).cast("long").alias("p"), "subroot", "path", "lefts", "widths")
    for nodes in trees[-2:0:-1]:
        outer = written(_met(nodes, outer, _down(False), _OUTER), "merkle-outer")
    return _met(placed, outer, _leaves(root.hex(), schema), schema)
