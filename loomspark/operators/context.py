"""From hit chunks to readable context: what stands above them, below them, and how it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators import tree as trees
from loomspark.operators.chunksets import GAP


def hit_ids(hits: DataFrame, file: str = "file_path", ids: str = "chunk_ids") -> DataFrame:
    """(file, local_index) of the chunks of all hits, each once."""
    return hits.select(file, F.explode(ids).alias("local_index")).distinct()


def expand(chunks: DataFrame, hits: DataFrame, file: str = "file_path") -> DataFrame:
    """(file, local_index) of the hits and their ancestors; ids that no chunk has stay. Hits are few, so the large side is read once, without a shuffle where the hits are small enough to be sent."""
    known = hits.join(chunks.select(file, "local_index", "ancestors"), [file, "local_index"], "left")
    all_ids = F.concat(F.coalesce("ancestors", F.array().cast("array<int>")), F.array(F.col("local_index").cast("int")))
    return known.select(file, F.explode(all_ids).alias("local_index")).distinct()


def deepest(chunks: DataFrame, hits: DataFrame, file: str = "file_path") -> DataFrame:
    """The hits that are no ancestor of another hit. Needs subtree_end (see tree.subtrees)."""
    at = hits.join(chunks.select(file, "local_index", "subtree_end"), [file, "local_index"], "left").alias("a")
    other = hits.select(F.col(file).alias("other_file"), F.col("local_index").alias("other"))
    inside = (F.col(f"a.{file}") == F.col("other_file")) & (F.col("other") > F.col("a.local_index")) & F.coalesce(F.col("other") < F.col("a.subtree_end"), F.lit(True))
    return at.join(other, inside, "left_anti").select(file, "local_index", "subtree_end")


def expand_deep(chunks: DataFrame, hits: DataFrame, file: str = "file_path", depths: list[int] | None = None) -> DataFrame:
    """(file, local_index) of the hits, of all below the deepest ones, and of all above any of these.

    What is above goes by depth over the whole file, whatever batch a chunk came with.
    """
    files = hits.select(file).distinct()
    own = chunks.join(files, file, "left_semi").select(file, "local_index", "depth")
    own = trees.subtrees(trees.link(own, [file], depths=depths), [file], depths=depths)
    known = hits.join(own.select(file, "local_index"), [file, "local_index"], "left_semi")
    low = deepest(own, known, file).select(F.col(file).alias("low_file"), F.col("local_index").alias("low"), F.col("subtree_end").alias("low_end"))
    below = (F.col(file) == F.col("low_file")) & (F.col("local_index") > F.col("low")) & F.coalesce(F.col("local_index") < F.col("low_end"), F.lit(True))
    found = own.select(file, "local_index").join(low, below, "left_semi").unionByName(hits.select(file, "local_index")).distinct()
    return expand(own, found, file)


def assemble(chunks: DataFrame, ids: DataFrame, file: str = "file_path") -> DataFrame:
    """(file, context, chunk_ids): contents in order, two spaces for each level, and a mark where chunks are left out. Ids without a chunk are passed over in the text."""
    row = ids.join(chunks.select(file, "local_index", "depth", "content"), [file, "local_index"], "left")
    has = F.col("content").isNotNull()
    previous = F.last(F.when(has, F.col("local_index")), ignorenulls=True).over(Window.partitionBy(file).orderBy("local_index").rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(F.col("local_index") - previous > 1, F.lit(GAP + "\n")).otherwise("")
    line = F.when(has, F.concat(gap, F.repeat(F.lit("  "), F.col("depth")), F.col("content")))
    parts = row.select(file, "local_index", line.alias("line")).groupBy(file).agg(F.array_sort(F.collect_list(F.struct("local_index", "line"))).alias("p"))
    return parts.select(file, F.array_join(F.array_compact(F.col("p.line")), "\n").alias("context"), F.col("p.local_index").alias("chunk_ids"))
