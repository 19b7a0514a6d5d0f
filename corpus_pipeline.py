"""From raw documents to token ids in five stages, each an operator of tidemark.llm over all that the last one kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.

Null and empty texts are judged like any other text (an empty one scores low and goes in the first stage);
a row is known by its id and its text: rows that repeat both are one document from the second stage on, rows that
repeat an id alone are judged by their own texts; an empty table stays empty; further columns of docs pass through all
stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, quality_model, secrets, simhash
from tidemark.llm.common import table, text_of, written
from tidemark.llm.queries import THRESHOLD, quality_trees


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at THRESHOLD or more stay."""
    keep = docs.columns
    trees = quality_trees(spark, sf_dir, docs)
    return quality_model.scored(docs, trees, "text", keep, "_tidemark_score").filter(F.col("_tidemark_score") >= THRESHOLD).select(*keep)


def _those(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose id and text are (left_semi) or are not (left_anti) in keys: _tidemark_id, _tidemark_tx."""
    text = F.xxhash64(text_of("text"))
    return docs.join(keys, F.col("_tidemark_id").eqNullSafe(docs.doc_id) & (F.col("_tidemark_tx") == text), how)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard of 0.8 or more, with what links them) one document stays: the one
    with the smallest id. A row is known by its id and its text; of rows that repeat both one stays."""
    heads = simhash.near_copies(docs).filter("first").groupBy(F.col("doc_id").alias("_tidemark_id"), F.col("tx").alias("_tidemark_tx")).agg(F.count("*").alias("n"))
    heads = written(heads, "heads")
    # Only rows that repeat others have to meet.
    once, more = (_those(docs, heads.filter(n).drop("n"), "left_semi") for n in ("n = 1", "n > 1"))
    again = more.withColumn("_tidemark_tx", F.xxhash64(text_of("text"))).dropDuplicates(["doc_id", "_tidemark_tx"]).drop("_tidemark_tx")
    return once.union(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a test item or more go; a row is known by its id and its text."""
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64(text_of("text")).alias("tx")).alias("doc_id"), "text")
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"))
    leaks = written(found.select(F.col("doc_id.id").alias("_tidemark_id"), F.col("doc_id.tx").alias("_tidemark_tx")).distinct(), "leaks")
    return _those(docs, leaks, "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the spans of secrets in its text are replaced by their kind."""
    return secrets.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids (unsigned 32-bit, little-endian)."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN, finish=bpe.digests_and_ids, schema=f"{bpe.DIGESTS}, token_ids binary").withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", tokens),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
