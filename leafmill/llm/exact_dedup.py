"""Exact deduplication by a tree-merge of sorted digest runs.

Rows are dealt into `fan_in ** rounds` runs. Within a run, equal texts meet and leave one entry: the identifier
that stays, and how many rows it stands for. In each round `fan_in` neighbouring runs exchange their sorted entries
and are merged into one, keeping the best identifier again, until one run is left. The answers then go back down the
same tree, so that no join ever sees a key with more rows than one run gives it: a text that is a third of all rows is
spread over all runs. A run is itself spread over tasks by digest; no level, the root included, goes through one task.

Entries are equal when SHA-256, byte length and a second, independent 64-bit hash agree at every level, which
verifies the digest match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shuffle_partitions, text_or_empty, written

KEY = ["digest", "n_bytes", "check"]


def digest_rows(docs: DataFrame, id_col: str, text) -> DataFrame:
    """row_no, doc_id and the key of every row; written, as row numbers must not change on a second reading."""
    return written(
        docs.select(
            F.monotonically_increasing_id().alias("row_no"),
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.xxhash64(text).alias("check"),
        ),
        "digests",
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of a group of equal texts stays. Null texts count as empty; null ids lose against any
    id; of rows that agree in id and text one is kept. No row, no result. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    rows = digest_rows(docs, id_col, text_or_empty(text_col))
    rounds = 1
    while fan_in**rounds < shuffle_partitions(spark):
        rounds += 1
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row_no"), F.lit(fan_in**rounds)))
    level = rows.groupBy("run", *KEY).agg(F.max(F.struct("doc_id", "row_no")).alias("best"), F.count(F.lit(1)).alias("n"))
    levels = []
    for _ in range(rounds):
        level = written(level, "runs")
        levels.append(level)
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in))
            .groupBy("run", *KEY)
            .agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        )
    answer = level.where("n > 1")
    for level in reversed(levels):
        answer = level.select("run", *KEY).alias("low").join(
            answer.withColumnRenamed("run", "up").alias("top"),
            (F.floor(F.col("low.run") / fan_in) == F.col("up")) & _same_key("low", "top"),
        ).select("low.*", "best", "n")
    return (
        rows.alias("low")
        .join(answer.alias("top"), (F.col("low.run") == F.col("top.run")) & _same_key("low", "top"), "left")
        .select(
            "low.doc_id",
            F.when(F.col("n").isNull(), F.col("low.doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("best.row_no") == F.col("low.row_no"), F.lit(True)).alias("kept"),
            F.lower(F.hex("low.digest")).alias("text_sha256"),
        )
    )


def _same_key(a: str, b: str):
    same = F.lit(True)
    for k in KEY:
        same = same & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return same


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, without the rows that duplicate_groups() drops; all columns as they are."""
    groups = written(duplicate_groups(docs, id_col, text_col), "groups")
    other = ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    drop = groups.where(other).select(F.col("doc_id").alias("__drop_id"), F.col("text_sha256").alias("__drop_sha")).distinct()
    sha = F.sha2(text_or_empty(text_col), 256)
    left = docs.join(drop, (sha == F.col("__drop_sha")) & F.col(id_col).eqNullSafe(F.col("__drop_id")), "left_anti")
    if groups.where(~other & ~F.col("kept")).isEmpty():
        return left
    return left.withColumn("__sha", sha).dropDuplicates([id_col, "__sha"]).drop("__sha")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
