"""Tables in the folder that all executors share (spark.checkpoint.dir).

They cut lineage: what they hold is read again instead of recomputed, also
when an executor is lost.  They go when the driver ends, or with `clear`.
"""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_COUNT = itertools.count()
_WRITTEN: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one is set only where the session names none and runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def store(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Writes df as a table of its own in the shared folder (with options of the Parquet writer) and reads it again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tables/{uuid.uuid4().hex[:12]}-{next(_COUNT)}-{name}"
    df.write.options(**(options or {})).parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Stands for the tables written so far."""
    return len(_WRITTEN)


def holds(df: DataFrame) -> bool:
    """Whether the tables that df was read from, of those written here, are still there."""
    paths = {p.rsplit("/", 1)[-1] for _, p in _WRITTEN}
    return all(f.rsplit("/", 2)[-2] in paths for f in df.inputFiles())


def clear(since: int = 0, but: DataFrame | None = None) -> None:
    """Removes the tables written since a mark, but for those that a DataFrame reads. Other results that read them must have been written first."""
    stay = {f.rsplit("/", 2)[-2] for f in but.inputFiles()} if but is not None else set()
    keep = []
    while len(_WRITTEN) > since:
        spark, path = _WRITTEN.pop()
        if path.rsplit("/", 1)[-1] in stay:
            keep.append((spark, path))
            continue
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            return
    _WRITTEN.extend(reversed(keep))


atexit.register(clear)
