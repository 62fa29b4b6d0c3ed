"""Keeping an index up to date with files that mostly grow at their end."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.outline import outline, token_length
from loomspark.functions.slices import in_slices
from loomspark.operators import chunksets, tree
from loomspark.sources import scratch
from loomspark.sources.store import Store, search_tables

UNCHANGED, TOUCHED, APPEND, REINDEX = "unchanged", "touched", "append", "reindex"


def fingerprint(text: Column | str, length: Column | None = None) -> Column:
    """SHA-256 of the text, or of its first characters."""
    return F.sha2(text if length is None else F.substring(text, F.lit(1), length), 256)


def classify(listing: DataFrame, records: DataFrame) -> DataFrame:
    """Adds what is to be done for each file (action), and for appends the new_text.

    The same time of change: unchanged, without a look at the text.  A known
    beginning and only white space after it: touched (the record moves on).  A
    known beginning and more text: append.  Everything else: reindex.
    """
    known = records.select("file_path", F.col("char_offset").alias("old_offset"), F.col("content_hash").alias("old_hash"), F.col("mtime").alias("old_mtime"))
    both = listing.join(known, "file_path", "left")
    begins = (F.col("old_offset") > 0) & (fingerprint("text", F.col("old_offset").cast("int")) == F.col("old_hash"))
    rest = F.expr("substring(text, cast(old_offset as int) + 1)")
    action = F.when(F.col("old_mtime") == F.col("mtime"), UNCHANGED).when(begins & ~rest.rlike(r"(?U)\S"), TOUCHED).when(begins, APPEND).otherwise(REINDEX)
    out = both.withColumn("action", action)
    return out.withColumn("new_text", F.when(F.col("action") == APPEND, rest).otherwise(F.col("text")))


def records_after(classified: DataFrame) -> DataFrame:
    """The records of the files that are not unchanged. White space at the end leaves the hash of what was known before with the new length."""
    changed = classified.where(F.col("action") != UNCHANGED)
    return changed.select("file_path", F.length("text").cast("long").alias("char_offset"), F.when(F.col("action") == TOUCHED, F.col("old_hash")).otherwise(fingerprint("text")).alias("content_hash"), "mtime")


_PIECES = T.ArrayType(T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("content", T.StringType())]))


def pieces_by(length: Callable[[str], int] | None = None):
    """The Arrow function that outlines each text; under a heading (depth, content) where there is one, which itself is left out. `length` gives the tokens of a text."""
    measure = length or token_length

    def pieces(text, depth, content) -> list[dict]:
        if content is None or depth is None:
            found = outline(text, length=measure)
        else:
            found = outline("#" * max(1, depth + 1) + " " + content + "\n" + (text or ""), title=False, length=measure)[1:]
        return [{"depth": a, "content": b} for a, b in found]

    @F.arrow_udf(_PIECES)
    def outlined(text: pa.Array, depth: pa.Array, content: pa.Array) -> pa.Array:
        return in_slices(pieces, pa.list_(pa.struct([("depth", pa.int32()), ("content", pa.string())])), text, depth, content)

    return outlined


outline_pieces = pieces_by()


def new_chunks(classified: DataFrame, chunks: DataFrame, length: Callable[[str], int] | None = None) -> DataFrame:
    """Chunks of the appended or rewritten texts, numbered on from those that stay; parents are looked for in the same batch only."""
    work = classified.where(F.col("action").isin(APPEND, REINDEX)).select("file_path", "action", "new_text")
    old = chunks.join(work.where(F.col("action") == APPEND).select("file_path"), "file_path", "left_semi")
    heading = F.max_by(F.struct("depth", "content"), F.when(F.col("depth") <= 1, F.col("local_index")))
    state = old.groupBy("file_path").agg(F.max("local_index").alias("last"), F.max("batch_id").alias("last_batch"), heading.alias("heading"))
    given = work.join(state, "file_path", "left")
    # max_by over no heading at all gives null
    pieces = given.withColumn("pieces", (outline_pieces if length is None else pieces_by(length))("new_text", F.col("heading.depth"), F.col("heading.content")))
    rows = pieces.select("file_path", (F.coalesce("last_batch", F.lit(-1)) + 1).alias("batch_id"), F.coalesce("last", F.lit(-1)).alias("last"), F.posexplode("pieces").alias("pos", "piece"))
    flat = rows.select("file_path", (F.col("last") + 1 + F.col("pos")).cast("int").alias("local_index"), F.col("piece.content").alias("content"), F.col("piece.depth").alias("depth"), F.col("batch_id").cast("int").alias("batch_id"))
    # written first: linking asks which depths there are, and the outline would be made twice
    linked = tree.link(scratch.table(flat), ["file_path", "batch_id"])
    return linked.select("file_path", "local_index", "content", "depth", F.col("parent").alias("parent_local_index"), "ancestors", "batch_id")


def new_chunksets(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Groups of the new chunks, numbered on per file."""
    groups = chunksets.simple(fresh.withColumnRenamed("parent_local_index", "parent"), ["file_path"])
    last = existing.groupBy("file_path").agg(F.max("local_index").alias("last"))
    return groups.join(last, "file_path", "left").select("file_path", (F.col("local_index") + F.coalesce("last", F.lit(-1)) + 1).cast("int").alias("local_index"), "chunk_ids", "contents", "to_embed")


_STATUS = {UNCHANGED: "unchanged", TOUCHED: "unchanged", APPEND: "updated", REINDEX: "reindexed"}


def apply(store: Store, listing: DataFrame, prune: bool = False, length: Callable[[str], int] | None = None) -> DataFrame:
    """Brings the index up to date with the listed files; a row for each: file_path, status, and for changed ones new_chunks and new_chunksets. prune also drops files that are not listed.

    What is to be done, and what comes in, is written before the index
    changes, so that nothing is worked out again from the changed index.
    `length` gives the tokens of a text by which pieces are bounded.
    """
    plan = classify(listing, store.read("files"))
    actions = scratch.table(plan.select("file_path", "action"))
    changed = scratch.table(plan.where(F.col("action") != UNCHANGED))
    counts = store.spark.createDataFrame([], "file_path string, new_chunks int, new_chunksets int")
    if not changed.isEmpty():
        again = changed.where(F.col("action") == REINDEX).select("file_path")
        kept = {t: store.read(t).join(again, "file_path", "left_anti") for t in ("chunks", "chunksets", "embeddings", "postings", "lengths", "chunk_stems", "chunkset_stems")}
        fresh = scratch.table(new_chunks(changed, kept["chunks"], length))
        groups = scratch.table(new_chunksets(fresh, kept["chunksets"]))
        n = fresh.groupBy("file_path").agg(F.count("*").cast("int").alias("new_chunks"))
        m = groups.groupBy("file_path").agg(F.count("*").cast("int").alias("new_chunksets"))
        counts = n.join(m, "file_path", "full")
        new = {"chunks": fresh, "chunksets": groups, **search_tables(fresh, groups)}
        # vectors of rewritten files go; appended groups have none yet
        names = changed.select("file_path")
        rows = {t: k.join(names, "file_path", "left_semi") for t, k in kept.items()}
        store.replace(names, {"files": records_after(changed), **{t: r.unionByName(new[t]) if t in new else r for t, r in rows.items()}})
    if prune:
        gone = store.read("files").select("file_path").join(listing.select("file_path"), "file_path", "left_anti")
        if not gone.isEmpty():
            store.delete(gone)
    status = F.create_map(*(F.lit(x) for p in _STATUS.items() for x in p))[F.col("action")]
    work = F.col("action").isin(APPEND, REINDEX)
    number = lambda c: F.when(work, F.coalesce(c, F.lit(0))).alias(c)
    return actions.join(counts, "file_path", "left").select("file_path", status.alias("status"), number("new_chunks"), number("new_chunksets"))


def update(store: Store, listing: DataFrame, prune: bool = False, length: Callable[[str], int] | None = None) -> list[dict]:
    """The same as a list, for a listing of few files."""
    rows = apply(store, listing, prune, length).orderBy("file_path").collect()
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in rows]
