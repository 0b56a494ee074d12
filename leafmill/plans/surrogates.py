"""The engine's inputs, made of the driver's tables: conversations are documents of pages, orders are tables and records,
events are job states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MARKER
from ..operators.sections import mark_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")


def marked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_pages(pages(spark, sf_dir), "doc_id", "page", "text")


def damaged_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, markdown, page_count: documents of id 0 mod 7 lack page 2's marker, those of 1 mod 7 have page 1's for it,
    those of 2 mod 7 begin with text."""
    kind = F.col("doc_id") % 7
    marked = (
        F.when((kind == 0) & (F.col("page") == 2), F.lit("")).when((kind == 1) & (F.col("page") == 2), F.lit(f"<!-- {MARKER}:1 -->\n"))
        .otherwise(F.concat(F.when((kind == 2) & (F.col("page") == 1), F.lit("intro\n")).otherwise(F.lit("")), F.lit(f"<!-- {MARKER}:"), F.col("page").cast("string"), F.lit(" -->\n")))
    )
    parts = pages(spark, sf_dir).select("doc_id", "page", F.concat(marked, F.coalesce("text", F.lit("")), F.lit("\n")).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("page", "part")))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["part"]), "").alias("markdown"), F.count(F.lit(1)).cast("int").alias("page_count"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (order), n (place of the line), part, qty, flag, status of every line of every order."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("at"),
        F.col("l_partkey").cast("string").alias("part"), F.col("l_quantity").cast("int").cast("string").alias("qty"), F.col("l_returnflag").alias("flag"),
    )
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"))
    numbered = lines.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))).drop("at")
    return numbered.join(orders, "doc_id")


def order_tables(spark: SparkSession, sf_dir: str, nested: bool = False) -> DataFrame:
    """doc_id, html: a table for each order with two header rows, whose order cell spans all its lines."""
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c), F.lit("</td>"))
    line = F.concat(cell("part"), cell("qty"), cell("flag"), F.lit("</tr>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda s: s["line"])
    head = "<table><tr><th rowspan=\"2\">Order</th><th colspan=\"2\">Item</th><th rowspan=\"2\">Flag</th></tr><tr><th>Part</th><th>Qty</th></tr>"
    grouped = order_lines(spark, sf_dir).groupBy("doc_id", "status").agg(rows.alias("rows"), F.count(F.lit(1)).alias("k"))
    body = F.concat(F.lit('<tr><td rowspan="'), F.col("k").cast("string"), F.lit('">'), F.col("doc_id").cast("string"), F.lit(" "), "status", F.lit("</td>"), F.array_join("rows", "<tr>"))
    return grouped.select("doc_id", F.concat(F.lit(head), body, F.lit("</table>")).alias("html"))


def plain_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, html: the same lines as simple tables with one header row, whose last header is blank."""
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c), F.lit("</td>"))
    line = F.concat(F.lit("<tr>"), cell("part"), cell("qty"), cell("flag"), F.lit("</tr>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda s: s["line"])
    grouped = order_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(rows, "").alias("rows"))
    return grouped.select("doc_id", F.concat(F.lit("<table><tr><th>Part</th><th>Qty | n</th><th></th></tr>"), "rows", F.lit("</table>")).alias("html"))


NOW = 1705708800  # 2024-01-20 in epoch seconds: a parameter of every query about age


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, job_id, status, updated_at of events; a job is a user."""
    status = F.element_at(F.array(*[F.lit(s) for s in ("queued", "processing", "succeeded", "failed", "expired")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_id"), status.alias("status"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("updated_at"),
    )
