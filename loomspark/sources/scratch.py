"""Tables made once and read many times, in the folder that all executors share (spark.checkpoint.dir).

They cut lineage: what they hold is read again instead of recomputed, also
when an executor is lost.  They go when the driver ends, or with `clear`.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[tuple[str, str], tuple[SparkSession, str]] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one is set only where the session names none and runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def path(spark: SparkSession, name: str) -> tuple[str, bool]:
    """A folder of its own for what is made once under that name in this application, and whether it is new."""
    key = (spark.sparkContext.applicationId, name)
    new = key not in _MADE
    if new:
        _MADE[key] = (spark, f"{folder(spark)}/scratch/{uuid.uuid4().hex}")
    return _MADE[key][1], new


def token() -> str:
    """A name that nothing else has."""
    return uuid.uuid4().hex


def table(df: DataFrame) -> DataFrame:
    """Writes df and reads it again."""
    where, _ = path(df.sparkSession, uuid.uuid4().hex)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def once(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name, built and written by the first who asks for it. The name says what it was made from, which must not change meanwhile."""
    where, new = path(spark, name)
    if new:
        try:
            build().write.parquet(where)
        except Exception:
            del _MADE[spark.sparkContext.applicationId, name]
            raise
    return spark.read.parquet(where)


def clear() -> None:
    """Removes everything made so far."""
    while _MADE:
        _, (spark, where) = _MADE.popitem()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            return


atexit.register(clear)
