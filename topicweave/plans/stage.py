"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LEFT: dict[str, list[str]] = {}
_LOCK, _OPEN = threading.Lock(), []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only if it is unset and Spark runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='topicweave-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the session's Python ends."""
    path = f"{shared_folder(spark)}/topicweave-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _LEFT:
        _LEFT[app] = []
        atexit.register(_drop, spark, app)
    _LEFT[app].append(path)
    return path


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with their query; tables may be staged from several threads."""
    with _LOCK:
        if not _OPEN:
            _OPEN.append(spark.conf.get(_CLEANUP, "false"))
            spark.conf.set(_CLEANUP, "true")
        _OPEN.append("")
    try:
        yield
    finally:
        with _LOCK:
            _OPEN.pop()
            if len(_OPEN) == 1:
                spark.conf.set(_CLEANUP, _OPEN.pop())


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks it was running, as
    the files are on storage that all executors share.
    """
    spark = df.sparkSession
    path = scratch(spark)
    with _cleaned(spark):  # the table is written: the shuffle files behind it can go at once
        df.write.option("compression", "snappy").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` partitioned by the keys over all cores, for work that is long for its few bytes: AQE would put small rows into one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def discard(table: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark, path = table.sparkSession, table._staged_at
    _LEFT.get(spark.sparkContext.applicationId, []).remove(path)
    _delete(spark, path)


def _drop(spark: SparkSession, app: str) -> None:
    try:
        for path in _LEFT.pop(app, []):
            _delete(spark, path)
    except Exception:  # the session is gone: the folder's owner cleans it
        pass


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``; ``build()`` makes it first if it isn't there whole."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
