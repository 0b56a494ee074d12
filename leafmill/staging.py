"""Written tables in the folder that driver and executors share: lineage ends there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
#: Written tables that are still there, with the Hadoop folder and file system they are in.
_kept: dict[str, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset a temporary folder is made, which is right only if driver and executors are one machine, as
    in tests; on a cluster that is refused.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_folder.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="leafmill-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and reread from a table in the shared folder: losing executors costs only what they were computing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/leafmill/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._leafmill_path = path
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    _kept[path] = (folder, folder.getFileSystem(spark._jsc.hadoopConfiguration()))
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() made and that nothing reads any more.

    Tables that a lazy result reads can't be deleted before the result is: these go when the driver ends.
    """
    for table in tables:
        _delete(table._leafmill_path)


def _delete(path: str) -> None:
    if path in _kept:
        folder, files = _kept.pop(path)
        files.delete(folder, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_kept):
        with contextlib.suppress(Exception):  # the JVM may be gone before
            _delete(path)
