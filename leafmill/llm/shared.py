"""What the operators of this subpackage share: the cluster's shared folder, written tables, bucketed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import discard, shared_folder, written

__all__ = ["SPACE", "SPACE_CHARS", "WORD", "discard", "running_totals", "shared_folder", "shuffle_partitions", "text_or_empty", "word_count", "written"]

#: Java pattern of white space between words; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters, literally, for translate() and trim().
SPACE_CHARS = " \t\n\x0b\f\r"

def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text):
    """Words in a text column."""
    return F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"))).cast("long")


#: Rows of a bucket of running_totals(), about, and buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 16


def running_totals(df: DataFrame, group: str, order: list[str], value: str, start: str) -> DataFrame:
    """df with `start`: the sum of `value` over the rows before this one in its group.

    Order within a group: a hash bucket of the columns `order`, then these columns. Rows that are equal in them are
    interchangeable. The number of buckets follows from the number of rows alone, so the result is the same under any
    settings and file layout. Each (group, bucket) is summed in its own task, so a group that holds a third of all rows
    is spread over many. Only the bucket totals meet, one row for each group and bucket. df must be a written table,
    since it is read several times.
    """
    buckets = LEAST_BUCKETS
    rows = df.count()
    while buckets * BUCKET_ROWS < rows:
        buckets *= 2
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    totals = df.groupBy(group, "__bucket").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col(group).alias("__g"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base")
    )
    within = Window.partitionBy(group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return (
        summed.join(bases, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__bucket") == F.col("__b")), "left")
        .withColumn(start, F.col("__base") + F.col("__within"))
        .drop("__g", "__b", "__base", "__within", "__bucket")
    )
