"""Index, search and status of a folder of documents."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomspark.operators import dense, incremental
from loomspark.plans import search as plans
from loomspark.sources import documents, scratch
from loomspark.sources.store import Store

FOLDER = ".agent/"
#: Dense search with the embedder that is installed, if any.
AUTO = "auto"


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("loomspark").getOrCreate()


def open_store(path: str | os.PathLike = FOLDER, db_path: str | os.PathLike | None = None, spark: SparkSession | None = None) -> Store:
    return Store(spark or session(), os.path.abspath(db_path or Path(path) / ".loomspark"))


def index(path: str | os.PathLike = FOLDER, db_path: str | os.PathLike | None = None, glob: str = "**/*.md", spark: SparkSession | None = None, prune: bool = False, length: Callable[[str], int] | None = None) -> dict:
    """Indexes what is new in the files of a folder. `length` gives the tokens of a text, by which long pieces are split; it travels to the workers."""
    store = open_store(path, db_path, spark)
    done = incremental.apply(store, documents.read_folder(store.spark, path, glob), prune, length)
    # totals only, however many files there are
    r = done.where("status <> 'unchanged'").agg(F.count("*").alias("files"), F.sum("new_chunks").alias("chunks"), F.sum("new_chunksets").alias("chunksets")).first()
    return {"files_indexed": r["files"], "chunks_created": r["chunks"] or 0, "chunksets_created": r["chunksets"] or 0}


def update_file(store: Store, file: str | os.PathLike, length: Callable[[str], int] | None = None) -> dict:
    """Brings one file up to date."""
    (row,) = incremental.update(store, documents.read_files(store.spark, [os.path.realpath(file)]), length=length)
    return {k: v for k, v in row.items() if k != "file_path"}


def embed_missing(store: Store, embedder: dense.Embedder) -> int:
    """Gives a vector to every group that has none, or one of another model; tells how many."""
    rows = store.with_embeddings().where(dense.stale(embedder.dims))
    fresh = scratch.table(dense.embed(rows.drop("embedding"), embedder).select("file_path", "local_index", "embedding"))
    n = fresh.count()
    if n:
        store.merge("embeddings", fresh)
    return n


def search(query: str, path: str | os.PathLike = FOLDER, db_path: str | os.PathLike | None = None, top_k: int = 5, spark: SparkSession | None = None, embedder: dense.Embedder | str | None = AUTO) -> list[dict]:
    """The best files with their context. An index that does not exist has no results.

    Keyword search, and where there is an embedder (the one installed, or the
    one given; None for none) fused with dense search.
    """
    store = open_store(path, db_path, spark)
    if not store.exists():
        return []
    vectors = None
    if embedder == AUTO:
        embedder = dense.default_embedder()
    if embedder is not None:
        embed_missing(store, embedder)
        vectors = store.with_embeddings()
    found = plans.hybrid(store.read("chunks"), store.read("chunksets"), query, top_k, embedder=embedder, vectors=vectors, index=store.keyword_index())
    return [r.asDict() for r in found.collect()]


def status(path: str | os.PathLike = FOLDER, db_path: str | os.PathLike | None = None, spark: SparkSession | None = None) -> dict:
    store = open_store(path, db_path, spark)
    if not store.exists():
        return {"files": [], "total_chunks": 0, "total_chunksets": 0, "has_embeddings": False, "embedded_chunksets": 0}
    return store.status()
