"""Reading documents: which files, their text, and when they changed."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file_path string, text string, mtime double"


def list_files(path: str | os.PathLike, glob: str = "**/*.md") -> list[str]:
    """Real paths in order; files whose own name begins with a dot are left out."""
    return [os.path.realpath(p) for p in sorted(Path(path).glob(glob)) if not p.name.startswith(".") and p.is_file()]


def read_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """One row a file: file_path, text with plain newlines, mtime in seconds. Bytes that are no UTF-8 raise."""
    if not files:
        return spark.createDataFrame([], SCHEMA)
    raw = spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?])", r"\\\1", f) for f in files])
    text = F.regexp_replace(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path")))), "\r\n?", "\n")
    return raw.select(F.regexp_replace("path", "^file:(//)?", "").alias("file_path"), text.alias("text"), F.col("modificationTime").cast("double").alias("mtime"))


def read_folder(spark: SparkSession, path: str | os.PathLike, glob: str = "**/*.md") -> DataFrame:
    """The files of a folder: of the local file system by glob, of any other (a path with a scheme) as Spark lists it."""
    if "://" in str(path):
        return read_tree(spark, str(path), glob.rsplit("/", 1)[-1])
    return read_files(spark, list_files(path, glob))


def read_tree(spark: SparkSession, path: str, name_glob: str = "*.md") -> DataFrame:
    """The same for a folder of any file system that Spark reads, listed by Spark."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name_glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.where(~name.startswith(".")).select(F.col("path").alias("file_path"), F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n").alias("text"), F.col("modificationTime").cast("double").alias("mtime"))
