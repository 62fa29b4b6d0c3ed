"""The whole of a search: candidates, fusion, files, context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import context, dense, fusion, keyword

KEY = ["file_path", "local_index"]


def results(chunks: DataFrame, chunksets: DataFrame, hits: DataFrame, top_k: int = 5, max_per_file: int = 3) -> DataFrame:
    """(file_path, score, context, chunk_ids) of the best files; hits have file_path, chunk_ids, contents, score and rank."""
    # top_k rows; their names reach the scan of the chunks as a filter
    best = fusion.rank_files(hits, k=top_k).collect()
    names = [r["file_path"] for r in best]
    files = hits.sparkSession.createDataFrame(best, "file_path string, score double, first_rank int")
    capped = fusion.cap_per_file(hits, most=max_per_file).where(F.col("file_path").isin(names))
    mine = chunks.where(F.col("file_path").isin(names))
    text = context.assemble(mine, context.expand(mine, context.hit_ids(capped)))
    # a file without chunks falls back on what was found
    plain = capped.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "contents"))), lambda x: x["contents"]), "\n").alias("found"))
    has = mine.select("file_path").distinct().withColumn("has", F.lit(True))
    out = files.join(text, "file_path").join(plain, "file_path").join(has, "file_path", "left")
    return out.select("file_path", "score", F.when(F.col("has"), F.col("context")).otherwise(F.col("found")).alias("context"), "chunk_ids", "first_rank").orderBy(F.desc("score"), "first_rank").drop("first_rank")


def hybrid(chunks: DataFrame, chunksets: DataFrame, query: str, top_k: int = 5, max_per_file: int = 3, embedder: dense.Embedder | None = None, vectors: DataFrame | None = None, index: tuple | None = None) -> DataFrame:
    """Keyword search, fused with dense search where there is an embedder and a table of vectors.

    `index` holds postings and statistics made before; else they are made here.
    """
    postings, stats = index or (keyword.postings(chunksets, KEY), keyword.statistics(chunksets))
    n = top_k * 3
    best = keyword.search(chunksets, postings, stats, query, KEY, n).select(*KEY, "chunk_ids", "contents", "score")
    if embedder is not None and vectors is not None:
        near = dense.search(vectors, [float(x) for x in embedder.embed([query])[0]], KEY, n, embedder.min_score).select(*KEY, "score")
        merged = fusion.reciprocal_ranks(best.select(*KEY, "score"), near, KEY, n)
        hits = merged.join(chunksets.select(*KEY, "chunk_ids", "contents"), KEY)
    else:
        hits = fusion.ranked(best, KEY)
    # three times top_k rows at most: taken once, so that nothing behind them is planned again
    hits = hits.select("file_path", "chunk_ids", "contents", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))
    hits = hits.sparkSession.createDataFrame(hits.collect(), hits.schema)
    return results(chunks, chunksets, hits, top_k, max_per_file)
