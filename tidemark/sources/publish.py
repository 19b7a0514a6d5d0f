"""Checked, immutable snapshots with manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import contracts
from ..functions import text
from ..operators import quality
from ..operators.filters import project
from ..shipping import ship
from .csv_sink import MANIFEST as MANIFEST_OF_CSV
from .csv_sink import PanelCsv
from .stores import Store


def summary(name: str, df: DataFrame) -> DataFrame:
    """One row: rows, first and last period, entities."""
    has = lambda c: c in df.columns
    return df.agg(
        F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), (F.min("period") if has("period") else F.lit(None).cast("date")).alias("earliest"),
        (F.max("period") if has("period") else F.lit(None).cast("date")).alias("latest"), (F.count_distinct("region_id") if has("region_id") else F.lit(None).cast("long")).alias("n_regions"),
    )


def publishable(name: str, df: DataFrame) -> DataFrame:
    """The contract's columns; paths are cut to names, values of mixed type are text, and secrets are refused when read."""
    out = project(df, contracts.CONTRACTS[name]) if name in contracts.CONTRACTS else df
    return out.withColumns({c: text.publishable(c, c) for c, kind in out.dtypes if kind == "string"})


MANIFEST = "manifest.json"
SUMMARY = "table_name string, n_rows long, earliest date, latest date, n_regions long"


def staged(name: str, df: DataFrame, path: str) -> tuple[list[tuple], tuple]:
    """Writes a table and returns the events of its checks and its summary, both from the pass that writes.

    Only the number of entities needs more: it is counted over one column of the files written, together with their rows,
    which have to be as many as were sent."""
    spark, has = df.sparkSession, lambda c: c in df.columns
    more = {"earliest": F.min("period"), "latest": F.max("period")} if has("period") else {}
    checked, found = quality.observed(name, df, more)
    publishable(name, checked).write.mode("errorifexists").parquet(path)
    events, got = found()
    kept = spark.read.parquet(path)
    n, entities = kept.agg(F.count(F.lit(1)), F.count_distinct("region_id") if "region_id" in kept.columns else F.lit(None).cast("long")).first()
    if n != got["rows"]:
        raise RuntimeError(f"{name}: {got['rows']} rows were written, {n} are in the files")
    return events, (name, n, got.get("earliest"), got.get("latest"), entities)


def promote(tables: dict[str, DataFrame], events: DataFrame | None, folder: str, core: Sequence[str] = ()) -> DataFrame:
    """Publishes a snapshot of all tables under `folder`, which must not exist, or nothing; returns its manifest.

    events: those of checks made before, which are read first, and once. core: tables that must not be empty, by the rows written. Then every table is written to a staging folder beside `folder` while it is
    checked, so that a table is read once for its checks, its grain, its summary and its files. When all tables are there and no check
    blocks, the manifest is written as the last file and the staging folder gets its name in one step, which fails if the name is
    taken. Until then nobody sees a snapshot; whatever fails before takes the staging folder along. A store without an atomic rename shows
    files early, but never the manifest before them: read with `snapshot`, which asks for it."""
    spark = next(iter(tables.values())).sparkSession
    store = Store(spark, folder)
    if store.exists(folder):
        raise FileExistsError(f"{folder} already exists")
    names = [c.split()[0] for c in quality.EVENT.split(", ")]
    before = [] if events is None else [tuple(r) for r in events.select(*names).collect()]
    if before:
        quality.gate(spark.createDataFrame(before, quality.EVENT))
    staging = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        rows, summaries = [], []
        for name, df in tables.items():
            found, one = staged(name, df, f"{staging}/{name}.parquet")
            rows += found
            summaries.append(one)
        empty = {one[0]: int(one[1] == 0) for one in summaries if one[0] in core}
        rows = [("core_table_not_empty", name, "critical", "failed" if n else "passed", n, 0) for name, n in empty.items()] + rows
        quality.gate(spark.createDataFrame(rows, quality.EVENT))
        every = [dict(zip(names, e, strict=True)) for e in before + rows]
        told = [dict(zip([c.split()[0] for c in SUMMARY.split(", ")], one, strict=True)) for one in summaries]
        store.put(f"{staging}/{MANIFEST}", json.dumps({"tables": told, "events": every}, ensure_ascii=False, indent=1, default=date.isoformat).encode())
        store.rename(staging, folder)
    except BaseException:
        store.delete(staging)
        raise
    return spark.createDataFrame(summaries, SUMMARY)


def snapshot(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """The tables of a snapshot, its manifest and the events it was published with; a folder without a manifest is none."""
    store = Store(spark, folder)
    if not store.exists(f"{folder}/{MANIFEST}"):
        raise FileNotFoundError(f"{folder} holds no published snapshot")
    held = json.loads(store.get(f"{folder}/{MANIFEST}"))
    rows = [(t["table_name"], t["n_rows"], *[t[c] and date.fromisoformat(t[c]) for c in ("earliest", "latest")], t["n_regions"]) for t in held["tables"]]
    events = [tuple(e[c.split()[0]] for c in quality.EVENT.split(", ")) for e in held["events"]]
    tables = {t["table_name"]: spark.read.parquet(f"{folder}/{t['table_name']}.parquet") for t in held["tables"]}
    return tables, spark.createDataFrame(rows, SUMMARY), spark.createDataFrame(events, quality.EVENT)


def write_csv(df: DataFrame, folder: str, compressed: bool = False, sep: str = ",", quoted: bool = False) -> DataFrame:
    """A new folder of CSV files as described in csv_sink; nested columns are JSON. Returns its manifest: source_file, rows, bytes, sha256.

    quoted: all values but nulls stand in quotes, so that empty texts are not read as null; a null in a table of one column is an error then."""
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(PanelCsv)
    plain = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    plain.write.format("panel_csv").mode("append").options(sep=sep, compression="gzip" if compressed else "none", quoted=quoted).save(folder)
    return csv_manifest(spark, folder)


def csv_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """source_file, rows, bytes, sha256 of the files that make up a folder of CSV; one that was not finished has none, which is an error."""
    held = json.loads(Store(spark, folder).get(f"{folder}/{MANIFEST_OF_CSV}"))
    return spark.createDataFrame([(m["file"], m["rows"], m["bytes"], m["sha256"]) for m in held], "source_file string, rows long, bytes long, sha256 string")


def checksums(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """source_file, sha256 of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(text.basename("path").alias("source_file"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, folder: str, manifest: DataFrame, df: DataFrame) -> DataFrame:
    """df, if every file of the manifest (source_file, sha256) is in the folder with that hash; else an error."""
    known = checksums(spark, folder).withColumnRenamed("sha256", "found")
    wrong = manifest.join(known, "source_file", "left").filter(~F.col("sha256").eqNullSafe(F.col("found"))).select("source_file").limit(5)
    names = [r[0] for r in wrong.collect()]
    if names:
        raise ValueError(f"files differ from their manifest: {', '.join(names)}")
    return df


def stringified(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(StringType()) for c in columns})
