"""Jobs as streams: files come in, states change, and the newest state of each job is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import upload_stream


def job_rows(files: DataFrame) -> DataFrame:
    """job_id, name, media_type, engine, status, error of classified files: rejected ones have failed, others are queued."""
    status = F.when(F.col("error").isNotNull(), "failed").otherwise("queued")
    return files.select(F.concat(F.lit("job_"), F.substring(F.sha2("path", 256), 1, 24)).alias("job_id"), "name", "media_type", "engine", status.alias("status"), "error")


def ingest(spark, source: str, target: str, checkpoint: str, files_per_trigger: int = 1000):
    """Reads the files that are there, once each, into a table of jobs; run again, it goes on where it stopped."""
    rows = job_rows(upload_stream(spark, source, files_per_trigger))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_states(states: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of job states (job_id, status, at) reduced to the newest of each job and hour; late rows count until the
    watermark has passed."""
    return (
        states.withWatermark("at", delay).groupBy("job_id", F.window("at", "1 hour").alias("hour"))
        .agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
    )


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, settings: Callable[[], dict] | None = None):
    """Runs `work` on each micro-batch; settings are read anew at its start. A batch may be repeated after a failure, so
    `work` must write by batch id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        work(batch.transform(lambda b: b.withColumns({k: F.lit(v) for k, v in (settings() if settings else {}).items()})), batch_id)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
