"""Putting ranked lists together, and files in order of their hits.

The inputs are lists of top hits, a few times k rows long, so a window over
all of them is one small partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(hits: DataFrame, key: list[str], name: str = "rank") -> DataFrame:
    """Adds the rank of each hit, from 1, best score first and ties in order of the key."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(F.desc("score"), *key)))


def reciprocal_ranks(first: DataFrame, second: DataFrame, key: list[str], k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """(key, score, rank) of the k best by the sum of 1 / (rrf_k + rank); ties as the first list has them, then the second."""
    a = ranked(first, key).select(*key, F.col("rank").alias("r1"), F.lit(None).cast("int").alias("r2"))
    b = ranked(second, key).select(*key, F.lit(None).cast("int").alias("r1"), F.col("rank").alias("r2"))
    both = a.unionByName(b).groupBy(*key).agg(F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    part = lambda r: F.coalesce(1 / (rrf_k + F.col(r)), F.lit(0.0))
    order = [F.desc("score"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"), *key]
    return both.withColumn("score", part("r1") + part("r2")).withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= k).select(*key, "score", "rank")


def cap_per_file(hits: DataFrame, file: str = "file_path", most: int = 3) -> DataFrame:
    """The first hits of each file by rank."""
    return hits.withColumn("in_file", F.row_number().over(Window.partitionBy(file).orderBy("rank"))).where(F.col("in_file") <= most)


def rank_files(hits: DataFrame, file: str = "file_path", k: int = 5) -> DataFrame:
    """(file, score, first rank) of the k files with the best hit; all hits count, also those beyond a cap."""
    return hits.groupBy(file).agg(F.greatest(F.lit(0.0), F.max("score")).alias("score"), F.min("rank").alias("first_rank")).orderBy(F.desc("score"), "first_rank").limit(k)
