"""Trees as ordered rows with a depth.

The order and the depths say everything: a row's parent is the last earlier
row that is shallower.  All operators are windows over (tree, order), one
shuffle by tree that they share.  Windows look at one running value per depth;
where trees are deeper than `MOST_DEPTHS` distinct depths, one vectorised
function per tree takes over.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.outline import ARROW, parents

MOST_DEPTHS = 16


def parse_lines(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """Arrow lines to rows: local_index, depth, content; lines without content are left out."""
    line = F.col("line")
    content = F.regexp_replace(line, f"^{ARROW}+", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.regexp_replace(x, f"^{ARROW}+", ""))) > 0)
    return df.select(*keep, F.posexplode(lines).alias("local_index", "line")).select(*keep, "local_index", (F.length(line) - F.length(content)).alias("depth"), content.alias("content"))


def _before(tree: list[str], order: str):
    return Window.partitionBy(*tree).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _after(tree: list[str], order: str):
    """All later rows, nearest last: a frame that ends at the last row is worked out anew for each row, one that grows from the first is not."""
    return Window.partitionBy(*tree).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)


def depths_of(df: DataFrame, depth: str = "depth") -> list[int]:
    """The distinct depths, at most MOST_DEPTHS + 1 of them."""
    return sorted(r[0] for r in df.select(depth).distinct().limit(MOST_DEPTHS + 1).collect())


def _last(depths: list[int], depth: str, order: str, window) -> dict[int, Column]:
    return {k: F.last(F.when(F.col(depth) == k, F.col(order)), ignorenulls=True).over(window) for k in depths}


def link(df: DataFrame, tree: list[str], order: str = "local_index", depth: str = "depth", depths: list[int] | None = None) -> DataFrame:
    """Adds parent (null for roots) and ancestors (from the root down to the parent)."""
    depths = depths_of(df, depth) if depths is None else depths
    if len(depths) > MOST_DEPTHS:
        return _link_deep(df, tree, order, depth)
    window = _before(tree, order)
    names = {k: f"last at depth {k}" for k in depths}
    kind = df.schema[order].dataType
    at = df.select("*", *(c.alias(names[k]) for k, c in _last(depths, depth, order, window).items()))
    # the last row of depth k is an ancestor when it is shallower and nothing shallower than it came later
    open_at: list[Column] = []
    for i, k in enumerate(depths):
        later = [F.col(names[j]) for j in depths[:i]]
        newest = F.greatest(*later) if len(later) > 1 else (later[0] if later else F.lit(None))
        ok = (F.col(depth) > k) & F.col(names[k]).isNotNull() & (F.col(names[k]) > F.coalesce(newest.cast(kind), F.lit(-1).cast(kind)))
        open_at.append(F.when(ok, F.col(names[k])))
    path = F.array_compact(F.array(*open_at)) if open_at else F.array().cast(f"array<{kind.simpleString()}>")
    out = at.withColumn("ancestors", path).drop(*names.values())
    return out.withColumn("parent", F.try_element_at("ancestors", F.lit(-1)))


def _link_deep(df: DataFrame, tree: list[str], order: str, depth: str) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        index, up = rows[order].tolist(), parents(rows[depth].tolist())
        paths: list[list[int]] = []
        for p in up:
            paths.append([] if p is None else [*paths[p], index[p]])
        return rows.assign(ancestors=paths, parent=pd.array([None if p is None else index[p] for p in up], "Int64"))

    kind = df.schema[order].dataType.simpleString()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"ancestors array<{kind}>", f"parent {kind}"])
    return df.groupBy(*tree).applyInPandas(run, schema)


def leaves(df: DataFrame, tree: list[str], order: str = "local_index", depth: str = "depth") -> DataFrame:
    """Adds is_leaf: the next row is not deeper."""
    following = F.lead(depth).over(Window.partitionBy(*tree).orderBy(order))
    return df.withColumn("is_leaf", ~F.coalesce(following > F.col(depth), F.lit(False)))


def subtrees(df: DataFrame, tree: list[str], order: str = "local_index", depth: str = "depth", depths: list[int] | None = None) -> DataFrame:
    """Adds subtree_end: the first later row that is not deeper (null: the rest of the tree belongs to it)."""
    depths = depths_of(df, depth) if depths is None else depths
    if len(depths) > MOST_DEPTHS:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(order)
            index, d, ends, stack = rows[order].tolist(), rows[depth].tolist(), [None] * len(rows), []
            for i, k in enumerate(d):
                while stack and d[stack[-1]] >= k:
                    ends[stack.pop()] = index[i]
                stack.append(i)
            return rows.assign(subtree_end=pd.array(ends, "Int64"))

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"subtree_end {df.schema[order].dataType.simpleString()}"])
        return df.groupBy(*tree).applyInPandas(run, schema)
    window = _after(tree, order)
    end = F.lit(None)
    for k in depths:
        first = F.last(F.when(F.col(depth) <= k, F.col(order)), ignorenulls=True).over(window)
        end = F.when(F.col(depth) == k, first).otherwise(end)
    return df.withColumn("subtree_end", end.cast(df.schema[order].dataType))
