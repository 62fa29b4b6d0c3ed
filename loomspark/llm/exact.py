"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by their leading bytes, and again by the bytes that
follow, until a group is a single document or its texts have ended; texts in
one group are then equal byte for byte, so no digest is taken anywhere.

Groups over `target` bytes are split across the cluster: for each level a
histogram of the next digit is counted (with partial sums on the map side),
and only prefixes still over the target go on, each digit four times as wide
as the last.  Documents of such a group whose text has ended are all equal
and meet in one aggregation that combines on the map side, so no task holds a
hot group.  Everything else is shuffled once, by the shortest prefix that is
not over the target, and the groups, now small, are split further where they
lie.

The row kept of equal texts has the smallest doc_id (nulls last, ties by the
other columns).

Defined results: null texts are equal to each other and not to empty ones;
texts that differ in case, spaces or normal form differ; of rows repeated
whole one stays; an empty table stays empty; texts of any length are compared
whole. All columns of the input are kept, whatever their names and types.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm import shared
from loomspark.llm.vec import lean, utf8

FIRST = 32
WIDER = 4
TARGET = 64 << 20
#: Bytes up to which a table of split prefixes is broadcast; a larger one is joined by shuffle.
BROADCAST = 16 << 20
#: Bytes of text a partition of the one shuffle should hold.
PARTITION = 32 << 20


def _digits(level: int, first: int) -> int:
    """Bytes of prefix that the levels up to this one look at."""
    return sum(first * WIDER**k for k in range(level + 1))


def _split_groups(docs: DataFrame, target: int, first: int) -> list[DataFrame]:
    """For each level the prefixes (column `prefix`) whose groups are over the target and have more bytes to split by."""
    data = docs.select(F.col("row.text_").cast("binary").alias("data"))
    hot, level = [], 0
    while True:
        width = _digits(level, first)
        prefix = F.substring("data", 1, width)
        size = F.sum(F.when(F.length("data") > width, F.length("data")).otherwise(0))
        over = shared.store(data.groupBy(prefix.alias("prefix")).agg(size.alias("bytes")).where(F.col("bytes") > target), f"radix-{level}")
        if over.isEmpty():
            return hot
        hot.append(over)
        # only the documents of these groups are looked at again
        data = shared.store(_join(data.where(F.length("data") > width).withColumn("prefix", prefix), over.select("prefix"), "left_semi").select("data"), f"radix-{level}-texts")
        level += 1


def _join(left: DataFrame, prefixes: DataFrame, how: str) -> DataFrame:
    """Joins the few prefixes that are split; by broadcast only where their measured size allows."""
    size = prefixes.agg(F.sum(F.length("prefix") + 16)).first()[0] or 0
    return left.join(F.broadcast(prefixes) if size <= BROADCAST else prefixes.hint("merge"), "prefix", how)


def _place(docs: DataFrame, hot: list[DataFrame], first: int) -> DataFrame:
    """Adds `prefix`, the shortest that is not split, and whether the text ended in a group that is."""
    data = F.col("row.text_").cast("binary")
    out = docs.withColumn("width", F.lit(_digits(0, first))).withColumn("ended", F.lit(False))
    for level, over in enumerate(hot):
        width, wider = _digits(level, first), _digits(level + 1, first)
        out = _join(out.withColumn("prefix", F.when(F.col("width") == width, F.substring(data, 1, width))), over.select("prefix", F.lit(True).alias("over")), "left")
        here = (F.col("width") == width) & F.col("over").isNotNull()
        out = out.withColumn("ended", F.col("ended") | (here & (F.length(data) <= width))).withColumn("width", F.when(here & (F.length(data) > width), wider).otherwise(F.col("width"))).drop("prefix", "over")
    return out.withColumn("prefix", F.substring(data, 1, F.col("width")))


def split(blob: bytes, start: np.ndarray, end: np.ndarray, members: list[int], at: int, width: int = 64) -> list[list[int]]:
    """Groups of equal texts among members, whose first `at` bytes are equal: splits by successive digits; only groups of two or more."""
    out, work = [], [(members, at, width)]
    while work:
        group, at, width = work.pop()
        ended, digits = [], defaultdict(list)
        for i in group:
            a = start[i] + at
            if a >= end[i]:
                ended.append(i)
            else:
                digits[blob[a : min(a + width, end[i])]].append(i)
        if len(ended) > 1:
            out.append(ended)
        # digits of unequal width belong to texts that end here; they are digits of their own
        work += [(g, at + width, width * 2) for g in digits.values() if len(g) > 1]
    return out


def _local(batches):
    """Rows sorted by prefix -> one row of each set of equal texts; holds one group of a prefix at a time."""
    carry = None

    def settle(b: pa.RecordBatch) -> pa.RecordBatch:
        prefix, row = b.column(b.schema.get_field_index("prefix")), b.column(b.schema.get_field_index("row"))
        n = b.num_rows
        new = np.ones(n + 1, bool)
        if n > 1:
            new[1:n] = pc.not_equal(prefix.slice(1), prefix.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        sizes = np.diff(first)
        many = np.flatnonzero(sizes > 1)
        if not len(many):
            return b.select(["row"])
        keep = np.ones(n, bool)
        data, off = utf8(row.field(row.type.get_field_index("text_")))
        blob, start, end = data.tobytes(), off[:-1].tolist(), off[1:].tolist()
        ids = b.column(b.schema.get_field_index("order_id"))
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        tie = b.column(b.schema.get_field_index("tie")).to_numpy(zero_copy_only=False)
        for k in many.tolist():
            a, z = int(first[k]), int(first[k + 1])
            # all members have this prefix, so the splitting goes on behind it
            for group in split(blob, start, end, list(range(a, z)), len(prefix[a].as_py())):
                keep[group] = False
                keep[min(group, key=lambda i: (null[i], ids[i], tie[i], i))] = True
        return b.select(["row"]).filter(pa.array(keep))

    for b in batches:
        if not b.num_rows:
            continue
        if carry is not None:
            b = pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
        prefix = b.column(b.schema.get_field_index("prefix"))
        n = b.num_rows
        changes = np.flatnonzero(pc.not_equal(prefix.slice(1), prefix.slice(0, n - 1)).to_numpy(zero_copy_only=False)) if n > 1 else np.empty(0, np.int64)
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if cut:
            yield settle(b.slice(0, cut))
        carry = b.slice(cut)
    if carry is not None:
        yield settle(carry)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", target: int = TARGET, first: int = FIRST) -> DataFrame:
    """The rows of df without those whose text equals that of another, of which one stays."""
    names = df.columns
    if len(set(names)) < len(names):
        raise ValueError("two columns have one name")
    # the input travels as one struct, so that its names cannot clash with ours; field k is column k
    fields = [f"c{i}" for i in range(len(names))]
    fields[names.index(text)] = "text_"
    at_id = fields[names.index(doc_id)] if doc_id in names else None
    docs = df.select(F.struct(*(F.col(f"`{c}`").alias(f) for c, f in zip(names, fields))).alias("row"))
    order_id = F.col(f"row.{at_id}").cast("long") if at_id else F.lit(None).cast("long")
    # maps have no hash of their own; as text they do
    tie = F.xxhash64(*(F.to_json(F.struct(F.col(f"row.{f}"))) if _has_map(df.schema[k].dataType) else F.col(f"row.{f}") for k, f in enumerate(fields)))
    order = F.struct(order_id.isNull(), order_id, tie)

    full = docs.where(F.col("row.text_").isNotNull())
    hot = _split_groups(full, target, first)
    placed = _place(full, hot, first)
    flat = placed.where(~F.col("ended")).select("row", order_id.alias("order_id"), tie.alias("tie"), "prefix")
    size = full.agg(F.sum(F.octet_length("row.text_"))).first()[0] or 0
    parts = size // PARTITION
    spread = flat.repartition(parts, "prefix") if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else flat.repartition("prefix")
    kept = spread.sortWithinPartitions("prefix").mapInArrow(lean(_local), docs.schema)
    if hot:
        kept = kept.unionByName(placed.where("ended").groupBy("prefix").agg(F.min_by("row", order).alias("row")).select("row"))
    null = docs.where(F.col("row.text_").isNull()).select(F.min_by("row", order).alias("row")).where(F.col("row").isNotNull())
    return kept.unionByName(null).select(*(F.col(f"row.{f}").alias(c) for c, f in zip(names, fields)))


def dedup_sql(table: str = "documents") -> str:
    return f"select * exclude (k) from (select *, row_number() over (partition by text order by doc_id nulls last) as k from {table}) where k = 1"
