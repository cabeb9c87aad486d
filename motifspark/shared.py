"""Tables written to the folder that the driver and all executors share."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_LOCAL = threading.local()


def _open(spark: SparkSession) -> list[list[str]]:
    """The open scratches of this thread and session, the innermost last."""
    by_session = _LOCAL.__dict__.setdefault("open", {})
    return by_session.setdefault(spark._jsparkSession.sessionUUID(), [])


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder, and an error unless Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set: the driver and the executors share no folder")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="motifspark-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and return a scan of it, so later uses do not compute it again.

    The files live in shared storage: a lost executor costs only its running tasks.  They stay until the ``scratch`` they
    were made in ends, else until ``clear``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/motifspark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    if found := _open(spark):
        found[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that ``materialise`` writes inside are deleted at the end, but for those whose paths are taken out of the list."""
    made: list[str] = []
    found = _open(spark)
    found.append(made)
    try:
        yield made
    finally:
        found.pop()
        for path in made:
            _delete(spark, path)


def result(df: DataFrame, name: str, made: list[str]) -> DataFrame:
    """``df`` written so that it outlives the scratch ``made``; it belongs to the scratch around that, if there is one."""
    out = materialise(df, name)
    path = made.pop()
    found = _open(df.sparkSession)
    if len(found) > 1:
        found[-2].append(path)
    return out


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written; DataFrames that still read it can no longer be used."""
    _delete(spark, f"{shared_dir(spark)}/motifspark-{spark.sparkContext.applicationId}")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file to any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def bucket_path(spark: SparkSession, name: str) -> str:
    """Where ``bucketed`` puts the files of a table."""
    return f"{shared_dir(spark)}/motifspark-{spark.sparkContext.applicationId}/{name}"


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> None:
    """Write ``df`` to the shared folder as a table whose files are bucketed and sorted by ``by``: joins on it move the other side only.

    It goes with ``dropped``, or its files with the scratch they were made in.
    """
    path = bucket_path(df.sparkSession, name)
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).format("parquet").saveAsTable(name)
    if found := _open(df.sparkSession):
        found[-1].append(path)


def dropped(spark: SparkSession, names: list[str]) -> None:
    """Delete tables made by ``bucketed``."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, bucket_path(spark, name))
