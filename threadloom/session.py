"""Spark session settings and the shared checkpoint folder."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A file stream writes its log of files taken whole now and then; Spark does so every tenth tick, so the cost would grow with the square of the ticks.
FILE_LOG_SETTINGS = {"spark.sql.streaming.fileSource.log.compactInterval": "200"}

SESSION_SETTINGS = {
    **FILE_LOG_SETTINGS,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A repeated JSON key keeps its last value instead of failing the line.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app_name: str = "threadloom", master: str | None = None, **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or one beside the session's own tables where that is unset.

    Only a local master may go without the setting; on a cluster a missing
    setting is an error, since a folder of one machine would not survive
    the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


def stage(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    This cuts the lineage on storage every executor can reach, and gives the
    optimizer real sizes, so that it broadcasts a side only when that is
    small. Used for narrow tables that several branches of a job read.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.stage_path = path
    return staged


_SCOPES = threading.local()


def _scopes() -> list[list[str]]:
    """Open scopes of this thread; streams run theirs in threads of their own."""
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    return _SCOPES.open


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder; it goes with the scope it was made in."""
    path = f"{_stage_folder(spark)}/{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is staged inside; results must be written by then."""
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            delete(spark, path)


def unstage(staged: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    delete(staged.sparkSession, staged.stage_path)


def _stage_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stages-{spark.sparkContext.applicationId}"


def drop_stages(spark: SparkSession) -> None:
    """Delete what this application staged, once its results have been written."""
    delete(spark, _stage_folder(spark))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that is in it, on whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
