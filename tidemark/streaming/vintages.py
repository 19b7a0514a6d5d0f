"""Vintage selection over a stream of releases: late vintages win or lose by their own date, not by when they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import latest_vintage


def maintain(releases: DataFrame, folder: str, checkpoint: str, grain: list[str], vintage: str, *ties: str) -> StreamingQuery:
    """Keeps the selected panel of a streaming frame in folder/v=N, one version a batch; `current` reads the newest.

    A batch joins the last version by union and selects again. Versions are written whole, so a batch that runs
    twice leaves the same panel.
    """

    def step(batch: DataFrame, number: int) -> None:
        panel = batch
        if number and (before := current(batch.sparkSession, folder, number - 1)) is not None:
            panel = before.unionByName(batch)
        latest_vintage(panel, grain, vintage, *ties).write.mode("overwrite").parquet(f"{folder}/v={number}")

    return releases.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def current(spark, folder: str, version: int | None = None) -> DataFrame | None:
    """The panel of a version, or of the newest one; None before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    versions = sorted(int(n[2:]) for n in names if n.startswith("v="))
    if version is not None:
        versions = [v for v in versions if v <= version]
    return spark.read.parquet(f"{folder}/v={versions[-1]}") if versions else None
