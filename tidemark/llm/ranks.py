"""Global ranks without a global window: a range sort, a count a partition, prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bits of monotonically_increasing_id that count rows within a partition.
PLACE_BITS = 33


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with name: 0, 1, ... in the order of the columns by (nulls first); rows that tie in all of them are put in some order.

    The range sort ends in a salt, so that a key which a third of the rows have is dealt to many tasks. Rows are written before
    they are dealt and again once they are in order, so that each reader sees the same numbers; the driver gets a row a partition.
    """
    spark = df.sparkSession
    rows = written(df.withColumn("_r_salt", F.monotonically_increasing_id()), "unranked")
    dealt = rows.repartitionByRange(*by, "_r_salt").sortWithinPartitions(*by, "_r_salt").drop("_r_salt")
    placed = written(dealt.withColumn("_r_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_r_id", PLACE_BITS)
    bases, base = [], 0
    for r in sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["p"]):
        bases.append((r["p"], base))
        base += r["n"]
    held = F.broadcast(spark.createDataFrame(bases, "_r_part long, _r_base long"))
    out = placed.withColumn("_r_part", part).join(held, "_r_part")
    return out.withColumn(name, F.col("_r_base") + F.col("_r_id").bitwiseAND((1 << PLACE_BITS) - 1)).drop("_r_part", "_r_base", "_r_id")
