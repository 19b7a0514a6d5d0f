"""What the operators of this folder share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_folder, shared_folder, written  # noqa: F401
from ..shipping import ship

#: White space of the word definition `[^\x20\x09-\x0D]+`, as a Java character class.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Nodes of an optimized plan that give each task the same rows in the same order whenever it runs.
_STEADY = {"Project", "Filter", "LogicalRelation", "Relation", "SubqueryAlias"}


def steady(df: DataFrame, name: str) -> DataFrame:
    """df, written first unless it only reads files: operators that read their input twice, or number its rows, need
    every task to see the same rows in the same order also when it runs again."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    nodes = {x.lstrip(" :+-").split(" ")[0].split("[")[0] for x in lines if x.strip()}
    return df if nodes <= _STEADY else written(df, name)


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


#: A key is hot if it has more than one in HOT_SHARE of all rows, so that there are fewer than HOT_SHARE hot keys.
HOT_SHARE, HOT_ROWS = 1_000, 1_000


def join_classes(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """rows with the columns of their class. classes: a written table with a row a key, and n, the key's number of rows.

    The classes of hot keys, fewer than HOT_SHARE, are broadcast, so that their rows stay where they are."""
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") > max(HOT_ROWS, total // HOT_SHARE)
    hot, cold = F.broadcast(classes.filter(is_hot).drop("n")), classes.filter(~is_hot).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    edges: columns a, b (any orderable type, a != b, no nulls). Returns node, component: the smallest
    node reachable. Every node takes the smallest label around it and then its label's label, so chains
    halve each round. One row a node is kept, in a written table a round; an empty graph gives no rows.
    Before the rounds each node's links to smaller ones become one link to the smallest and links of the others to
    that one, which many nodes have in common in a dense group.
    """
    down = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    edges = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", "m")).distinct()  # each once, its greater end first
    each_way = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # a union would join twice
    both = written(edges.select("a", "b").select(each_way.alias("edge")).select("edge.*"), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(max_rounds):
        of = labels.select(F.col("node").alias("b"), F.col("component").alias("seen"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        hop = labels.join(near, "node").select("node", F.least("component", "seen").alias("component"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = written(hop.join(up, "component").select("node", F.least("component", "root").alias("component"), "was"), "labels")
        if new.filter("component <> was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
