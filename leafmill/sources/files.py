"""Sources and sinks: uploaded files, job states, records, engine outputs, and results in each format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import base_name, suffix_of
from ..operators.records import JOB_ID
from ..operators.routing import engine_of, media_type, safe_name, upload_error

JOB_SCHEMA = (
    "job_id string, status string, progress struct<current_page:int,total_pages:int>, result_path string, updated_at double, "
    "error struct<code:string,message:string>"
)


def classified(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """files (path, length, content) with name, media_type, engine and error; rejected files stay, with their error."""
    header = F.substring("content", 1, 16)
    named = files.withColumn("file_name", base_name(F.col("path"))).withColumn("media_type", media_type(header, F.col("file_name")))
    return (
        named.withColumn("name", safe_name(F.col("file_name"), F.col("media_type"))).withColumn("engine", engine_of(F.col("media_type")))
        .withColumn("error", upload_error(F.col("length"), F.col("media_type"), settings)).drop("file_name")
    )


def uploads(spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> DataFrame:
    """The files of a folder. What a plan doesn't ask of the content isn't read: the length limit is pushed down."""
    return classified(spark.read.format("binaryFile").load(path), settings)


def upload_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000, settings: Settings = DEFAULTS) -> DataFrame:
    stream = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_trigger)
    return classified(stream.schema("path string, modificationTime timestamp, length long, content binary").load(path), settings)


def job_states(spark: SparkSession, path: str) -> DataFrame:
    """Job states from JSON files; ids that aren't job ids are left out."""
    return spark.read.schema(JOB_SCHEMA).option("multiLine", True).json(path).where(F.col("job_id").rlike(JOB_ID))


def engine_outputs(spark: SparkSession, path: str) -> DataFrame:
    """doc, text, markdown, html, json, error: the first file of each suffix in each document's folder."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), "value")
    keyed = files.select(F.element_at(F.split("path", "/"), -2).alias("doc"), "path", suffix_of(base_name(F.col("path"))).alias("suffix"), "value")
    first = lambda s: F.min_by(F.when(F.col("suffix") == s, F.col("value")), F.when(F.col("suffix") == s, F.col("path")))
    out = keyed.groupBy("doc").agg(first(".txt").alias("text"), first(".md").alias("markdown"), first(".html").alias("html"), first(".json").alias("json"))
    return out.withColumn("error", F.when(F.coalesce("text", "markdown", "html", "json").isNull(), "ENGINE_UNAVAILABLE"))


def output_limits(files: DataFrame, doc: str, settings: Settings = DEFAULTS) -> DataFrame:
    """doc, error: documents for which an engine wrote too many files or bytes."""
    total = files.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    return total.select(doc, F.when((F.col("n") > settings.engine_output_files) | (F.col("bytes") > settings.engine_output_bytes), "PDF_RESOURCE_LIMIT").alias("error"))


def table_rows(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table of a relational store; filters are pushed into it."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()


def write_results(results: DataFrame, path: str, kind: str = "parquet") -> None:
    """Results as parquet or JSON files; Spark's commit makes them appear whole or not at all."""
    results.write.mode("append").format(kind).save(path)


def write_outputs(outputs: DataFrame, path: str, formats: tuple[str, ...] = ("text", "json", "markdown", "html")) -> None:
    """A folder of lines for each format, partitioned by nothing: the document id stands in front as JSON."""
    for name in formats:
        if name in outputs.columns:
            outputs.where(F.col(name).isNotNull()).select("doc_id", F.col(name)).write.mode("overwrite").json(f"{path}/{name}")


def upgrade(users: DataFrame, root: str = "root") -> DataFrame:
    """Users of the older schema, with is_admin: true for the root user."""
    return users if "is_admin" in users.columns else users.withColumn("is_admin", F.col("username") == root)
